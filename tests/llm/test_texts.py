"""Operators on texts: op1 scores, op5 chat windows, op6 main text, op7 quality; the pipeline."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pulsefleet.llm.chat import chat_digest, chat_windows, escaped, unescaped
from pulsefleet.llm import contextmix
from pulsefleet.llm.contextmix import lm_scores, text_class
from pulsefleet.llm.htmltext import best_region, extract, main_text, page_weights, token_scores, tokens
from pulsefleet.llm.quality import Network, quality_scores

SYLLABLES = ["ti", "de", "por", "ta", "lis", "gu", "ro", "pe", "mas", "é"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n))


def test_language_model_scores(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(120))) for i in range(300)] + [(300, None), (301, " \t"), (302, "Unseen-Word " + "x" * 3000), (None, "some text"), (5, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as row")
    got = {r["doc_id"]: r for r in lm_scores(df).filter("doc_id is not null and n_bytes <> 13").collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows[:303]:
        r, own = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["score"] < 0 and math.isfinite(r["score"])
    # Words drawn at random from a small list are the base's own case: the mix must come close to it.
    held = [got[i] for i in range(300) if out(i)]
    assert sum(r["score"] for r in held) > 1.02 * sum(r["base_score"] for r in held)
    assert lm_scores(df.limit(0)).count() == 0 and lm_scores(df.filter("doc_id = 302")).count() == 1


def scalar_scores(rows, fitted):
    """Scores made again token by token in plain Python, from the rows and the fitted tables alone."""
    totals, (tables, spell_w), (odds, w, refine) = fitted
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    texts = [(i, text_class(t or ""), [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    train = [(k, ws) for i, k, ws in texts if not out(i)]
    words = Counter(x for _, ws in train for x in ws)
    classes = Counter((k, x) for k, ws in train for x in ws)
    pairs = Counter((a, b) for _, ws in train for a, b in zip([None, *ws], ws))
    n, n_class = sum(words.values()), Counter(k for k, ws in train for _ in ws)
    squash = lambda x: 1 / (1 + math.exp(-max(-14, min(14, x))))
    level = lambda x: min(math.ceil(math.log2(max(x, 0) + 1)), 15)
    costs = {}

    def spelled(word):
        if word not in costs:
            s = contextmix.Spelled([word if word == b"\n" else word + b" "])
            total = 0.0
            for y, at in s.bits():
                for i in range(len(y)):
                    known, mix = 0, 0.0
                    x = []
                    for k in range(contextmix.ORDERS):
                        zeros, ones = (float(tables[j][at[k, i]]) - (word in words and words[word] > 0 and y[i] == j) for j in (0, 1))
                        zeros, ones = max(zeros, 0), max(ones, 0)
                        known += zeros + ones > 0
                        x.append(math.log((ones + 0.4) / (zeros + 0.4)))
                    gate = min(int(s.pos[i]), 3) * (contextmix.ORDERS + 1) + known
                    mix = sum(a * b for a, b in zip(spell_w[gate], [*x, 0.3]))
                    total += math.log10(squash(mix if y[i] else -mix))
            costs[word] = total
        return costs[word]

    scores = []
    for i, k, ws in texts:
        leave = not out(i)
        own, own_pairs = Counter(ws), Counter(zip([None, *ws], ws))
        size = len(ws) if leave else 0
        done, done_pairs, hits, total = Counter(), Counter(), [], 0.0
        for t, x in enumerate(ws):
            prev = ws[t - 1] if t else None
            before = (len(train) - leave) if t == 0 else words[prev] - leave * own[prev]
            seen = before + (0 if t == 0 else 4 * (done[prev] - 1))
            share = lambda a, b: a / b if b > 0 else 0.0
            p = [
                share(pairs[prev, x] - leave * own_pairs[prev, x] + 4 * done_pairs[prev, x], seen),
                share(done[x], t),
                share(classes[k, x] - leave * own[x], n_class[k] - size),
                share(words[x] - leave * own[x], n - size),
            ]
            pattern = sum(hits[-1 - j] << j for j in range(3) if j < len(hits))
            prefix = xxhash.xxh64_intdigest(prev) >> 52 if t else 0
            slots = [level(seen) * 8 + pattern, prefix, sum(hits[-16:]) * 16 + k, level(t) * 16 + level(seen)]
            told, left = 0.0, 1.0
            for flag in range(4):
                inputs = [*(odds[flag][contextmix.OFFSETS[j] + at] for j, at in enumerate(slots)), 0.3]
                mix = sum(a * b for a, b in zip(w[flag][level(seen)], inputs))
                at = (max(-7.999, min(7.999, sum(inputs[:-1]) / 4)) + 8) * 2
                low = int(at)
                q = 0.5 * squash(mix) + 0.5 * (refine[flag][low] * (1 - at + low) + refine[flag][low + 1] * (at - low))
                q = max(1e-5, min(1 - 1e-5, q))
                told += left * q * p[flag]
                left *= 1 - q
            last = spelled(x) + math.log10(left)
            total += math.log10(told + 10**last) if told else last
            hits.append(int(p[0] > max(p[2], p[3])))
            done[x] += 1
            done_pairs[prev, x] += 1
        scores.append((i, total + float(contextmix.class_shares(totals)[k])))
    return scores


def lm_rows():
    rng = random.Random(2)
    lines = [prose(rng, 8) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([prose(rng, 5), rng.choice(lines)]) for _ in range(rng.randrange(8)))) for i in range(60)]
    return [*rows, (60, None), (61, rows[3][1]), (62, "Only Here-x \u00e9\u00e9 " * 3), (3, "a repeated id"), (None, "no id at all")]


def test_scores_equal_a_token_by_token_model(spark):
    rows = lm_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ready, totals, spelling = contextmix.prepared(df, 10)
    model = contextmix.learned_flags(ready, totals)
    want = sorted(scalar_scores(rows, (totals, spelling, model)), key=str)
    got = sorted(((r["doc_id"], r["score"]) for r in lm_scores(df).collect()), key=str)
    assert [g[0] for g in got] == [x[0] for x in want]
    assert [g[1] for g in got] == pytest.approx([x[1] for x in want], rel=1e-5)


def test_scores_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    one_way = {(r["doc_id"], r["n_bytes"]): r["score"] for r in lm_scores(df.repartition(1)).collect()}
    run = contextmix.chunks
    monkeypatch.setattr(contextmix, "chunks", lambda rows, mod: run(rows.repartition(7), mod))
    other = {(r["doc_id"], r["n_bytes"]): r["score"] for r in lm_scores(df).collect()}
    assert other == {k: pytest.approx(v, rel=1e-6) for k, v in one_way.items()}


def test_tables_between_jobs_are_few_files_and_a_chunk_is_read_alone(spark, monkeypatch):
    """Each file that Spark writes to a local disk makes an executor start two processes."""
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    want = {(r["doc_id"], r["n_bytes"]): r["score"] for r in lm_scores(df).collect()}
    files, rows, groups, write = {}, {}, set(), contextmix.materialize

    def seen(df, label, **named):
        out = write(df, label, **named)
        files[label], rows[label] = len(out.inputFiles()), out.count()
        if label == "lm-chunks":
            for uri in out.inputFiles():
                file = pq.ParquetFile(uri.removeprefix("file://"))
                groups.update(file.metadata.row_group(i).num_rows for i in range(file.num_row_groups))
        return out

    monkeypatch.setattr(contextmix, "materialize", seen)
    monkeypatch.setattr(contextmix, "CHUNK_TOKENS", 20)
    monkeypatch.setattr(contextmix, "STEP_BYTES", 50)
    got = {(r["doc_id"], r["n_bytes"]): r["score"] for r in lm_scores(df.repartition(2)).collect()}
    assert got == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}
    assert rows["lm-chunks"] > 10 and files["lm-chunks"] <= 2 and groups == {1}
    assert files["lm-types"] == files["lm-counted"] == 1 < int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_groups_of_texts_are_scored_as_the_whole_chunk(spark, monkeypatch):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string").coalesce(1)
    ready, totals, _ = contextmix.prepared(df, 10)
    model = contextmix.learned_flags(ready, totals)
    rows = [r.asDict() for r in ready.select("texts", "tok", "words", "pairs").collect()]
    whole = np.concatenate([s.log_p(contextmix.flag_probabilities(s, *model)) for s in contextmix.shares_of(iter(rows), totals)])
    monkeypatch.setattr(contextmix, "GROUP_TOKENS", 30)
    parts = [s.log_p(contextmix.flag_probabilities(s, *model)) for s in contextmix.shares_of(iter(rows), totals)]
    assert len(parts) > 5 and np.allclose(np.concatenate(parts), whole)


def test_order_and_copies_count(spark):
    rng = random.Random(4)
    phrases = [prose(rng, 6) for _ in range(40)]
    text = lambda: " ".join(rng.choice(phrases) for _ in range(20))
    rows = [(i, text()) for i in range(200)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    shuffled = [(1000 + i, dict(rows)[i].split()) for i in range(200)]
    for _, words in shuffled:
        rng.shuffle(words)
    more = [(i, " ".join(x)) for i, x in shuffled if zlib.crc32(str(i).encode()) % 10 == 0]
    alone = [(3000 + i, prose(rng, 60)) for i in range(30)]
    twice = [(4000 + i, t) for i, (_, t) in enumerate(alone[:5])]
    got = {r["doc_id"]: r for r in lm_scores(spark.createDataFrame([*rows, *more, *alone, *twice], "doc_id long, text string")).collect()}
    for i, _ in more:
        assert got[i]["score"] < 1.3 * got[i - 1000]["score"]  # the same words in another order
    assert sum(got[i]["score"] for i in held) > 0.5 * sum(got[i]["base_score"] for i in held)
    once = [got[i]["bits_per_byte"] for i, _ in alone[5:] if not got[i]["held_out"]]
    again = [got[i]["bits_per_byte"] for i, _ in alone[:5] if not got[i]["held_out"] and not got[i + 1000]["held_out"]]
    assert max(again, default=0) < 0.7 * min(once)


def test_a_very_long_word_takes_linear_time():
    import time

    tables, w = contextmix.odds_tables(np.zeros((2, contextmix.ORDERS * contextmix.SPELL_SLOTS))), np.full((contextmix.SPELL_GATES, contextmix.ORDERS + 1), 0.2)
    began = time.process_time()
    cost = contextmix.spelling_costs(b"x" * 1_000_000, np.array([1_000_000]), np.array([False]), tables, w)
    assert math.isfinite(cost[0]) and time.process_time() - began < 30


def test_short_words_are_hashed_together(monkeypatch):
    """Hashes are XXH64's; only words of 32 bytes and more are hashed one by one."""
    rng, one, asked = random.Random(4), xxhash.xxh64_intdigest, []
    words = [rng.randbytes(n) for n in [*range(70), *(rng.randrange(70) for _ in range(500))]]
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: asked.append(len(w)) or one(w))
    for own in (words, [], [b""], [b"\xff" * 31], [b"\xff" * 32]):
        assert contextmix.word_hashes(b"".join(own), np.array(list(map(len, own)), np.int32)).tolist() == list(map(one, own))
    assert min(asked) == 32


@pytest.mark.parametrize(("kind", "values"), [("<i4", [0, 1, 255, 256, 70000, 2**31 - 1]), ("<i4", [-1, 5]), ("<i8", [0, 2**40, 7]), ("<i8", [])])
def test_byte_planes_come_back(kind, values):
    x = np.array(values, kind)
    raw = contextmix.planes(x, kind)
    assert len(raw) == x.nbytes and contextmix.from_planes(np.frombuffer(raw, np.uint8), kind).tolist() == values


def test_all_white_space_parts_words():
    texts = [b" a\tB\nc\vd\fe\rf ", b"", b"\x08\x0e\x1c \x85\xa0", "wör   ter".encode()]
    joined, lengths, sizes = contextmix.words_of(texts)
    ends = np.cumsum(lengths)
    words = [joined[e - k : e].tobytes() for e, k in zip(ends, lengths, strict=True)]
    assert words == [w for t in texts for w in [*t.lower().split(), b"\n"]] and sizes.tolist() == [len(t.split()) + 1 for t in texts]


def test_spelled_words_are_a_probability():
    """All words of up to three letters of a small alphabet: with their ends they add up to less than 1."""
    rng = np.random.default_rng(3)
    tables = rng.integers(0, 9, (2, contextmix.ORDERS * contextmix.SPELL_SLOTS))
    tables = contextmix.odds_tables(tables)
    w = rng.normal(0.2, 0.1, (contextmix.SPELL_GATES, contextmix.ORDERS + 1))
    first = [bytes([b]) for b in range(256) if b not in b" \t\n\v\f\r"] + [b"\n"]
    flat, sizes = b"".join(first), np.array([1] * len(first))
    one = spelled_total = (10 ** contextmix.spelling_costs(flat, sizes, np.zeros(len(sizes), bool), tables, w)).sum()
    two = [a + b for a in first[:-1] for b in first[:-1]]
    spelled_total += (10 ** contextmix.spelling_costs(b"".join(two), np.array([2] * len(two)), np.zeros(len(two), bool), tables, w)).sum()
    assert 0 < one < spelled_total < 1


ROLES = ["system", "user", "assistant", "tool: x", "a\\b", ""]
BITS = ["### user: ", " </turn>\n", "\\", "#", "##", "plain words ", "</turn>", "é", "\n", "<\\/turn>", "#\\#", ""]


def test_chat_escape_is_reversible_and_safe(spark):
    texts = ["".join(x) for k in range(4) for x in itertools.product(BITS[:9], repeat=k)][:700] + BITS
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).select("t", "e", unescaped(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and "###" not in r["e"] and "</turn>" not in r["e"]


def test_chat_windows_read_back(spark):
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for k in range(rng.randrange(1, 14)):
            rows.append((c, k, "system" if k == 0 and c % 2 else rng.choice(ROLES[1:]), rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randrange(60)))])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as window", "3 as start")
    windows = chat_windows(df, budget=120, history=40).cache()
    got = {r["conv_id"]: r for r in chat_digest(windows).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    whole = {r["conv_id"]: r["text"] for r in chat_windows(df, budget=10**6, history=0).collect()}
    tokens = lambda x: sum(math.ceil((len(p) + 9) / 4) for p in x.split(" </turn>\n")[:-1])
    for r in windows.collect():
        new = r["text"][r["new_start"] :]
        assert r["n_turns"] == new.count(" </turn>\n") and (r["n_turns"] == 1 or tokens(r["text"]) <= 120)
        assert all(m["start"] >= r["new_start"] for m in r["mask"])
        if r["conv_id"] % 2 and r["window"]:
            assert r["text"].startswith(whole[r["conv_id"]][: whole[r["conv_id"]].index(" </turn>\n")])  # the system turn stays
    assert chat_digest(chat_windows(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_windows(df, budget=10, history=10)


@pytest.mark.parametrize("system", [0, 40, 700, 9000])
def test_no_window_of_several_turns_exceeds_the_budget(spark, system):
    """Windows made again by hand from prefix sums; long conversations of short turns, any system turn."""
    rng = random.Random(system)
    turns = [("system", "s" * system)] * bool(system) + [(("user", "assistant")[k % 2], "x" * rng.choice([3, 8, 30, 200, 2500])) for k in range(150)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    pieces = [f"### {r}: {t} </turn>\n" for r, t in turns]
    size = [math.ceil(len(p) / 4) for p in pieces]
    start = [sum(size[:k]) for k in range(len(size))]
    stride = max(1, 512 - 128 - (size[0] if system else 0))
    spans: list[list[int]] = []
    for k in range(len(size)):
        here = (start[k] // stride, (start[k] + size[k] - 1) // stride)
        if spans and last == here:
            spans[-1].append(k)
        else:
            spans.append([k])
        last = here
    want = []
    for span in spans:
        again = [k for k in range(1 if system else 0, span[0]) if start[span[0]] - start[k] <= 128]
        want.append("".join(pieces[k] for k in [*([0] if system and span[0] else []), *again, *span]))
    got = chat_windows(df, budget=512, history=128).orderBy("window").collect()
    assert [r["text"] for r in got] == want
    for r, span in zip(got, spans, strict=True):
        if len(span) > 1:
            assert sum(math.ceil(len(p + " </turn>\n") / 4) for p in r["text"].split(" </turn>\n")[:-1]) <= 512


def test_chat_without_keys_and_with_a_very_long_text(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", long), (5, 1, "assistant", long), (5, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_digest(chat_windows(df)).collect()}
    assert (got[None]["n_turns"], got[None]["loss_chars"], got[5]["n_turns"], got[5]["loss_chars"]) == (2, 1, 3, len(long))
    assert got[5]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies here.</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>ly put\n  text &#233; here, with words.</p><div class="ad-box"><p>Buy now</p></div>
<form><label>Mail</label></form><script>var t="</p>";</script><p>Second paragraph with several words.<p>Third<br>one.
<section class="comments"><p>I like it very much indeed, many words of praise.</p></section></article>
<aside>Related things</aside><footer>&copy; me</footer></body></html>"""
TEXT = "Head & line First boldly put text é here, with words. Second paragraph with several words. Third one."


def test_main_text(spark):
    assert main_text(PAGE, {}) == TEXT
    assert main_text(None, {}) == main_text("", {}) == main_text("<p></p>", {}) == ""
    assert main_text("a < b", {}) == "a < b"
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert main_text(plain, {}).endswith("several words. Third one.")
    rows = [(1, "u", PAGE), (2, None, None), (1, "u", PAGE), (3, "v", "<nav><a>x</a></nav>"), (4, "w", "<p>" + "long text " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text")
    got = sorted((r["page_id"], r["n_chars"]) for r in extract(df).collect())
    assert got == [(1, len(TEXT)), (1, len(TEXT)), (2, 0), (3, 0), (4, 299_999)]
    assert page_weights(df)["word:article"] > 1 > 0 > page_weights(df)["tag:nav"]
    assert extract(df.limit(0)).count() == 0 and page_weights(df.limit(0)) == {}


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single has-sidebar">{}</body>',
        '<html class="no-sidebar"><body>{}</body></html>',
        '<body><div class="content-sidebar-wrap"><article>{}</article></div></body>',
        '<body><main><div class="content-sidebar-wrap"><article>{}</article></div></main></body>',
        '<body><div id="page-header-wrap"><div class="post">{}</div></div></body>',
        '<body><article class="legal">{}</article></body>',
        '<body><article><section class="popular-science">{}</section></article></body>',
        '<body><form id="aspnetForm"><div>{}</div></form></body>',
    ],
)
def test_a_name_does_not_drop_the_article(page):
    text = " ".join(f"word{i}" for i in range(40))
    both = f"<p>{text}</p><p>{text}</p>"
    rest = '<div class="related-posts"><a href="x">More of this</a></div><div class="ad">Buy</div>'
    assert main_text(page.format(both + rest), {}) == f"{text} {text}"
    comments = f'<div class="comments"><article class="comment"><p>{text} said</p></article></div>'
    assert "said" not in main_text(f"<body><main><p>{text}</p><p>{text}</p>{comments}</main></body>", {})


@pytest.mark.parametrize("top", ['<header class="entry-header"><h1>The headline</h1></header>', '<div class="post-header"><h1>The headline</h1></div>', "<header><h1>The headline</h1></header>", "<h1>The headline</h1>"])
def test_headlines_and_captions_stay(top):
    text = " ".join(f"word{i}" for i in range(40))
    caption = "<figure><img src=x><figcaption>What it shows</figcaption></figure>"
    page = f'<body><header class="site-header"><p>Site name</p></header><div class="post">{top}<p>{text}</p>{caption}<p>{text}</p></div><footer>foot</footer></body>'
    assert main_text(page, {}) == f"The headline {text} What it shows {text}"


def test_the_region_equals_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2, 5]) for _ in range(rng.randrange(25))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        lo, hi = best_region(scores)
        assert sum(scores[lo:hi]) == max([0, *sums.values()])
    found = list(tokens(PAGE))
    assert len(token_scores(found, {})) == len(found)


@pytest.mark.parametrize("tag", ['<svg viewBox="0 0 1 1"/>', "<svg/>", "<math/>", "<title-bar></title-bar>", "<object-view>", "<svg><text>no</text></svg>"])
def test_a_raw_element_ends_where_it_ends(tag):
    assert main_text(f"<body><p>one two three four</p>{tag}<p>five six seven</p></body>", {}) == "one two three four five six seven"


def test_formulas_are_kept():
    assert main_text("<p>so that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here</p>", {}) == "so that x=2 holds here"


def quality_rows(n):
    rng = random.Random(11)
    rows = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).replace(" ", "### ")) for i in range(n)]
    return rows, [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows(600)
    df = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string").selectExpr("*", "1 as score", "0 as quality")
    marks = spark.createDataFrame([*labels, (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(df, marks).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.97
    assert quality_scores(df.limit(0), marks).count() == 0
    none = quality_scores(df.limit(3), marks.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_of_repeated_keys_and_several_labels(spark):
    rows, labels = quality_rows(120)
    df = spark.createDataFrame([*rows, (0, rows[1][1]), (1, rows[0][1])], "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    # Three labels of a key count by their mean.
    marks = spark.createDataFrame([*labels, *((i, y, 0) for i, y, _ in labels), *((i, 1 - y, 0) for i, y, _ in labels)], "doc_id long, quality int, toxic int")
    got = quality_scores(df, marks, carry=["row"]).collect()
    assert len(got) == 122 and len({r["row"] for r in got}) == 122
    scores = {}
    for r in got:
        scores.setdefault(r["doc_id"], []).append(r["predicted"])
    assert sorted(scores[0]) == [0, 1] == sorted(scores[1])


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = Network(x, y, 8, 20, 1).score(x)
    for lo in (0.1, 0.4, 0.7):
        at = (p >= lo) & (p < lo + 0.2)
        assert abs(p[at].mean() - y[at].mean()) < 0.08


def test_pipeline_stages(spark, tmp_path):
    rows, labels = quality_rows(240)
    rng = random.Random(5)
    item = " ".join(prose(rng, 1) + str(i) for i in range(30))
    good = [i for i in range(240) if i % 3]
    texts = dict(rows)
    texts[300], texts[301] = texts[good[0]], texts[good[1]] + " "
    texts[302] = prose(rng, 30) + " " + item + " " + prose(rng, 30)
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, at, str(tmp_path))
        assert nxt.columns == at.columns
        kept.append({r["doc_id"] for r in nxt.collect()})
        at = nxt
    assert {300, 301, 302} <= kept[0] and sum(i in kept[0] for i in range(0, 240, 3)) <= 2 and len(kept[0] & set(good)) >= 158
    assert kept[0] - kept[1] == {300, 301} and kept[1] - kept[2] == {302}
    # Rows are judged by themselves: keys that are null or repeated, copies under one key, clashing names.
    odd = [(None, texts[good[5]]), (None, texts[good[5]]), (good[6], texts[good[7]]), (good[6], texts[good[6]]), (good[6], texts[302]), (None, texts[302]), (8, None), (9, "")]
    odd = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'k' as words", "1 as component_id", "2 as score", "3 as h")
    assert corpus_pipeline.quality(spark, odd, str(tmp_path)).columns == odd.columns
    left = corpus_pipeline.near_duplicates(spark, odd, str(tmp_path))
    assert left.columns == odd.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(None, texts[good[5]]), (good[6], texts[good[7]]), (good[6], texts[good[6]]), (good[6], texts[302]), (8, None)], "doc_id long, text string").collect()))
    left = corpus_pipeline.decontamination(spark, odd, str(tmp_path))
    assert left.columns == odd.columns and left.count() == 6 and left.filter(F.col("text") == texts[302]).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == kept[2] and (out.groupby("sequence_id").length.sum() <= 4096).all()
