"""Operators 11 to 13 against plain Python, and row numbers that hold."""

import hashlib
import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pulsefleet.llm import align, licenses, whitening
from pulsefleet.llm.bpe import byte_alphabet
from pulsefleet.llm.common import row_numbers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a\nb \nc", " x  y ", "▁", "a▁b", "<|endoftext|> hi <s>", "日本語 ünïcode 😀😀", "\n\n\tq", "x" * 3000, "é" * 400, "tab\tsep  and\r\nnl", "  lead", "trail  ", "the cat sat", "the cat sat", "<0x41> &nbsp;"]


# --- alignment ---------------------------------------------------------------------------------------


def both_sides(text, t, s):
    back = {c: b for b, c in byte_alphabet().items()}
    if not text:
        return [], []
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(n[3:5], 16)]) if s.is_byte(i) else n.replace("▁", " ").encode()) for i, n in ((i, s.id_to_piece(i)) for i in s.encode(text))]
    want = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == want for side in (a, b)) else ([], [])


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    found, count = [], Counter()
    for text in texts:
        sides = both_sides(text, t, s)
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in sides]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            group = []
            for k in (0, 1):
                lo = at[k]
                while at[k] < len(ends[k]) and ends[k][at[k]] <= cut:
                    at[k] += 1
                group.append([i for i, _ in sides[k][lo : at[k]]])
            groups.append(group)
        links = [(x, y) for a, b in groups for x in a for y in b]
        count.update(set(links))
        found.append((*map(len, sides), groups, links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    text_of = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [(na, nb, len(g), len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(text_of(g).encode()).hexdigest() if na else "") for na, nb, g, ls in found]


def test_alignment_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 300)
    monkeypatch.setattr(align, "SPREAD", 50)
    rows = [(i if i % 5 else None, t, 1) for i, t in enumerate(ODD)]
    got = align.alignments(spark.createDataFrame(rows, "doc_id long, text string, pairs int"), A, B).collect()
    assert Counter(map(tuple, got)) == Counter((k, *x) for (k, _, _), x in zip(rows, plain_alignment([t for _, t, _ in rows]), strict=True))
    assert align.alignments(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_new_words_of_a_text_are_encoded_together(monkeypatch):
    both, calls = align.Sides(A, B), []
    model = both.b.model
    monkeypatch.setattr(both.b, "model", SimpleNamespace(encode=lambda x, **named: calls.append(x) or model.encode(x, **named)))
    words = [f"word{i} and{i}" for i in range(40)]
    first = both.ids(" ".join(words) + " some some")
    assert len(calls) == 1
    again = both.ids(" ".join(words) + " some some")
    assert len(calls) == 1 and all((x == y).all() for x, y in zip(first, again, strict=True))
    assert first[1].tolist() == model.encode(" ".join(words) + " some some")
    # Words that don't come back as they are, or that don't stand alone, are encoded with their text.
    for text in ("so \ufb01ne a word", "two  spaces", "a\nline \n\nmore", "it's \u2581x", "\u65e5\u672c \u8a9e"):
        ids = both.ids(text)
        want = model.encode(text)
        assert ids[1].tolist() == (want if b"".join(both.bytes[1][i] for i in want) == b" " + text.encode() else [])
        assert b"".join(both.bytes[0][i] for i in ids[0]) in (b"", b" " + text.encode()) and bool(len(ids[0])) == bool(len(ids[1]))


def test_groups_break_where_a_start_reaches_the_largest_end():
    starts, ends, side = np.array([0, 2, 4, 0, 3, 4]), np.array([2, 4, 6, 3, 4, 6]), np.array([0, 0, 0, 1, 1, 1])
    order, group = align.coalesced(starts, ends, side)
    assert group[np.argsort(order)].tolist() == [0, 0, 1, 0, 0, 1]


# --- license scan --------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = dict(licenses.NOTICES[:1])["mit"]
    changed = " ".join(w for i, w in enumerate(mit.split()) if i not in (5, 14)).replace("software and", "software, and also")
    texts = [None, "", "Released under the MIT License.", "x apache license, version 2 y apache LICENSE version 2", "by cc by nc 4.0 cc-by-nc", mit, changed, "nothing here", "under the mit licence", "This work is licensed under the GNU General Public License, version 3.", "cc by ncé", "a b " * 4000 + "under the mit license " * 300]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "under the mit license", 1), (2, "other text", 2)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    want = Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for key, text, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        places = sorted((i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        at = [i for i, _ in places]
        want[key, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 2)}
    assert all(set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1 for r in got)
    assert by_id[5]["labels"] == "mit" == by_id[6]["labels"] and by_id[5]["score"] == 1 > by_id[6]["score"] >= 0.8
    assert by_id[9]["labels"] == "gpl-3" and by_id[7]["labels"] == "" and by_id[0]["score"] == 0
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- whitening -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_against_eigenvectors(spark, parts):
    made = np.random.default_rng(3).normal(0, 1, (400, 12)) @ np.diag(np.arange(12, 0, -1.0)) + 5
    rows = [(i, [float(x) for x in v], "y") for i, v in enumerate(made.astype(np.float32))]
    rows += [(900, None, "n"), (901, [], "n"), (902, [1.0] * 11 + [None], "n"), (903, [math.nan] * 12, "n"), (904, [math.inf] * 12, "n"), (905, [1.0] * 5, "n"), (7, [0.5] * 12, "again"), (None, [0.25] * 12, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(parts)
    got = whitening.whitened(df, top=5).toPandas()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows if v and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v)])
    y = len(x) * x - x.sum(axis=0)
    e, u = np.linalg.eigh(y.astype(float).T @ y / len(x) ** 3)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 5 * len(x) and set(got["n"]) == {len(x)}
    assert Counter(got[got.component == 1]["deviation"]) == Counter((y * y).sum(axis=1).tolist())
    assert np.allclose(got.groupby("component")["explained"].first(), e[:5] / e.sum(), rtol=1e-10) and got["identity_error"].max() < 1e-10
    want = y / len(x) @ u[:, :5] / np.sqrt(e[:5])
    for k in range(5):
        have = np.sort(np.abs(got[got.component == k + 1]["whitened"].to_numpy()))
        assert np.allclose(have, np.sort(np.abs(want[:, k])), atol=1e-9)


def test_whitening_without_spread_and_without_rows(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], kind)).toPandas()
    assert set(flat["component"]) == {1} and flat["explained"].iloc[0] == pytest.approx(1)


def test_factor_and_rotation():
    m = np.random.default_rng(1).normal(size=(9, 6))
    v = m @ m.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape == (9, 6) and np.allclose(factor @ factor.T, v)
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.allclose(gram, np.diag(gram.diagonal()), atol=1e-9) and np.allclose(gram.diagonal(), np.linalg.eigvalsh(v)[::-1][:6])


# --- row numbers -----------------------------------------------------------------------------------------


def test_row_numbers_do_not_follow_the_cores(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.range(4000).withColumn("text", F.repeat(F.lit("x"), F.col("id").cast("int") % 50)).repartition(40).write.parquet(path)
    seen = []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
            seen.append({(r["id"], r["row"]) for r in row_numbers(spark.read.parquet(path), "row").select("id", "row").collect()})
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert seen[0] == seen[1] and len({row for _, row in seen[0]}) == 4000
    made = row_numbers(spark.createDataFrame([("a",), ("b",)], "t string"), "row")
    assert len({r["row"] for r in made.collect()} | {r["row"] for r in made.collect()}) == 2
