"""Tokenizing operators: op2 edit counts, op8 packing, op9 token files."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from pulsefleet.llm.bpe import Cache, CachedBpe
from pulsefleet.llm.editcount import Counter, Tree, apply_edits, edited, token_trees
from pulsefleet.llm.packing import Sums, pack_documents, plan_packing
from pulsefleet.llm.tokenfile import FrameReader, read_token_files, token_file_digest, write_token_files

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "\n", "a  b", "a \n b", " x", "x ", "don't 'll ''s x's", "é́ İ Σ", "<|endoftext|> a", "日本 語 text", "a\x1cb c", "12½ ab12", "a\r\nb", "It'S 'S'll", "tab\tq", "A" * 5000, "wörter und mehr"]


@pytest.mark.parametrize(("path", "words"), [(BYTE, False), (WORD, True)])
def test_cached_ids_equal_the_library(path, words):
    bpe, rng = CachedBpe(path, words), random.Random(3)
    texts = ODD + ["".join(rng.choice(ODD + [" ", "the", " of", "\n"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    for text in texts:
        assert bpe.ids(text) == bpe.whole(text), text[:80]


def test_one_new_word_leaves_the_known_ones_alone(monkeypatch):
    """Words that the cache holds are looked up once, in one go; only new ones are asked for one by one."""
    bpe, asked, get = CachedBpe(BYTE, False), [], Cache.get
    bpe.ids("the house by the river was old")
    monkeypatch.setattr(Cache, "get", lambda self, key, make: asked.append(key) or get(self, key, make))
    text = "the house by the quixl was old"
    assert bpe.ids(text) == bpe.whole(text) and asked.count("quixl") == 1 and not {"house", "by", "was", "old"} & set(asked)


def test_a_known_word_is_not_merged_again_with_something_behind_it(monkeypatch):
    bpe, asked = CachedBpe(BYTE, False), []
    bpe.ids("the quixl wöxl was old")
    merged = bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda text: asked.append(text) or merged(text))
    text = "the quixl, quixl. wöxl'll (quixl\nquixl 'quixl wöxl12"
    assert bpe.ids(text) == bpe.whole(text) and asked and not {" quixl", " wöxl"} & set(asked)


def test_a_full_cache_forgets_the_oldest_half():
    cache, made = Cache(4), []
    for key in "abcabdea":
        assert cache.get(key, lambda k: made.append(k) or k.encode()) == key.encode()
    assert made == list("abcdea") and len(cache.young) <= 2 and len(cache.old) <= 2


def docs(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return rows.selectExpr("*", "'x' as shard", "1 as length", "2L as key", "0 as nth", "0 as part") if extra else rows


def ids(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()


def test_token_files_round_trip(spark, tmp_path):
    texts = [*ODD, None, "same", "same"]
    folder = f"file://{tmp_path}/files"
    manifest = write_token_files(docs(spark, texts, extra=True), BYTE, 2, folder, n_files=3)
    want, start = [], 0
    for i, t in enumerate(texts):
        raw = ids(BYTE, t, 2)
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = [tuple(r) for r in token_file_digest(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()]
    assert got == want
    some = {r["doc_id"]: bytes(r["ids"]) for r in read_token_files(manifest, folder, keys=[7, 3]).collect()}
    assert some == {k: ids(BYTE, texts[k], 2) for k in (3, 7)}
    unkeyed = spark.createDataFrame([(None, "b"), (5, "z"), (5, "a"), (None, None)], "doc_id long, text string")
    manifest = write_token_files(unkeyed, BYTE, 2, f"file://{tmp_path}/unkeyed", n_files=2)
    got = [tuple(r) for r in token_file_digest(manifest, f"file://{tmp_path}/unkeyed").select("doc_id", "ids_crc32").orderBy("start").collect()]
    assert got == [(k, zlib.crc32(ids(BYTE, t, 2))) for k, t in ((None, ""), (None, "b"), (5, "a"), (5, "z"))]
    assert [r["doc_id"] for r in read_token_files(manifest, f"file://{tmp_path}/unkeyed", keys=[5, 0]).collect()] == [5, 5]
    assert write_token_files(docs(spark, []), BYTE, 2, f"file://{tmp_path}/none").count() == 0


def test_a_damaged_frame_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = write_token_files(docs(spark, ["some words here", "and some more"]), BYTE, 2, folder, n_files=1)
    path = manifest.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[9] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        with pafs.LocalFileSystem().open_input_file(path) as f:
            FrameReader(f).frame(0)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_fills_and_uses_each_piece_once(seed):
    rng = random.Random(seed)
    lengths = [min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(rng.choice([1, 10, 500]))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = plan_packing(counts, 100)
    assert all(sum(p) <= 100 and n > 0 for p, n in plan)
    assert {x: sum(p.count(x) * n for p, n in plan) for x in counts} == counts
    # At most one sequence in ten above the lower bound (best fit alone needs more on such lengths).
    assert sum(n for _, n in plan) <= -(-sum(lengths) // 100) * 1.1 + 1


def test_complements_equal_brute_force():
    """Whatever was taken before: a complement of up to three lengths is found exactly if there is one."""
    rng = random.Random(12)
    for _ in range(60):
        counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(rng.choice([2, 6, 20]))}
        sums = Sums(counts, 60)
        for _ in range(40):
            gap = rng.randrange(1, 61)
            have = {x: int(n) for x, n in enumerate(sums.left) if n > 0}
            possible = any(sum(c) == gap and all(c.count(x) <= have[x] for x in c) for k in (1, 2, 3) for c in itertools.combinations_with_replacement(have, k))
            found = sums.complement(gap)
            assert bool(found) == possible and (not found or sum(found) == gap and all(found.count(x) <= have.get(x, 0) for x in found))
            for x in found if rng.random() < 0.5 else ():
                sums.take(x)


def test_exact_complements_are_found():
    assert sorted(plan_packing({70: 1, 50: 1, 30: 1, 25: 2}, 100)) == sorted([((70, 30), 1), ((50, 25, 25), 1)])
    assert plan_packing({60: 2, 15: 2, 14: 2, 11: 2}, 100) == [((60, 15, 14, 11), 2)]
    assert sum(n for _, n in plan_packing({60: 2, 20: 2, 11: 2, 9: 2}, 100)) == 2
    assert plan_packing({}, 100) == []


def test_packing_keeps_rows_without_and_with_repeated_keys(spark):
    rows = spark.createDataFrame([(None, "the tide"), (None, None), (4, "of"), (4, "of"), (4, "a station")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["ids_crc32"]) for r in pack_documents(rows, WORD, 1, 16).collect()), key=str)
    assert got == sorted(((k, zlib.crc32(ids(WORD, t, 1))) for k, t in ((None, "the tide"), (None, ""), (4, "of"), (4, "of"), (4, "a station"))), key=str)


def test_packed_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "tidal", "station", "of", "x"]) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "word " * 300]
    rows = pack_documents(docs(spark, texts, extra=True), WORD, 1, 64).toPandas()
    want = []
    for i, t in enumerate(texts):
        raw = ids(WORD, t, 1)
        want += [(i, n, lo // 4, len(raw[lo : lo + 256]) // 4, zlib.crc32(raw[lo : lo + 256])) for n, lo in enumerate(range(0, len(raw), 256))]
    assert sorted(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(own.length.cumsum() - own.length) and own.length.sum() <= 64
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 64) + 2
    assert pack_documents(docs(spark, []), WORD, 1, 64).count() == 0


PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "don't", "12", "é", "日本", " x", "<|endoftext|>", "!!", "'", "\t", "\r\n", "re", "s", " the"]


def test_edits_equal_a_full_count():
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    full = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    counter, rng = Counter(BYTE), random.Random(5)
    for _ in range(300):
        make = lambda n: "".join(rng.choice(PARTS) for _ in range(n))
        text = make(rng.choice([0, 3, 30, 600]))
        tree = Tree(*counter.leaves(counter.pattern(text).findall(text)))
        for _ in range(4):
            at, cut, new = rng.randint(-1, len(text) + 3), rng.choice([0, 1, 2, 7, 40]), make(rng.choice([0, 0, 1, 2, 9, 200]))
            lo = min(max(at, 0), len(text))
            want = text[:lo] + new + text[min(lo + cut, len(text)) :]
            text, tree, _ = edited(text, tree, counter, at, cut, new)
            assert text == want and tree.total == full(want) and tree.node[0, 1] == len(want)


def test_an_edit_touches_a_small_part_of_a_long_text():
    counter = Counter(BYTE)
    text = "some words that go on and on. " * 3000
    tree = Tree(*counter.leaves(counter.pattern(text).findall(text)))
    _, _, work = edited(text, tree, counter, 45_000, 5, "other")
    assert work < 1500


def test_edit_rows(spark):
    rows = token_trees(docs(spark, ["one two three", None, "x"]), BYTE)
    edits = "case doc_id when 0 then array(named_struct('start', 3, 'length', 4, 'text', ' 2'), cast(null as struct<start:int,length:int,text:string>)) when 1 then array(named_struct('start', 0, 'length', 0, 'text', 'new')) end as edits"
    got = {r["doc_id"]: r for r in apply_edits(rows.selectExpr("*", edits), BYTE).collect()}
    assert got[0]["text"] == "one 2 three" and got[1]["text"] == "new" and got[2]["n_tokens"] == got[2]["n_tokens_before"] == 1
    assert got[0]["n_tokens"] == 3 and got[1]["n_tokens_before"] == 0
    # Trees can be taken up again.
    again = apply_edits(spark.createDataFrame([got[0]]).selectExpr("doc_id", "text", "cast(leaf_chars as array<int>) leaf_chars", "cast(leaf_tokens as array<int>) leaf_tokens", "sums", "array(named_struct('start', 0, 'length', 3, 'text', 'six')) as edits"), BYTE).first()
    assert (again["text"], again["n_tokens"], again["n_tokens_before"]) == ("six 2 three", 3, 3)


def test_edit_rows_of_odd_tables(spark):
    """Empty tables, names that clash with the operator's own, keys that are null or repeated."""
    rows = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as sums", "2 as leaf_chars", "3 as n_tokens")
    trees = token_trees(rows, BYTE)
    done = apply_edits(trees.selectExpr("*", "array(named_struct('start', 0, 'length', 0, 'text', 'so ')) as edits"), BYTE).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in done), key=str) == sorted([(None, "so a b"), (3, "so x"), (3, "so x"), (None, "so ")], key=str)
    assert token_trees(rows.limit(0), BYTE).count() == 0
