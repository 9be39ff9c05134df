"""The training-data operators against brute force, SQL and round trips, with awkward inputs."""

import collections
import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.llm import chat, fingerprints, licences, mixing, near_dup, oracles, packing, quality, queries, suffix_dedup, toxicity, vectors
from quillmere.llm.common import tokenizer_path
from quillmere.llm.components import components
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHES = ("size", "rep", "component", "bucket", "part", "row", "batch", "node", "score", "_key", "rank", "extra", "target", "n", "words")


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


LONG = " ".join(f"w{n % 977}x{n % 13}" for n in range(60_000))
PASSAGE = "this passage of more than fifty bytes stands in several of the documents, word for word."
AWKWARD = [
    (None, "a row without an id", "a"), (1, None, "a"), (2, "", None), (3, "one", "b"), (4, "one two three four five six", "b"), (5, LONG, "c"), (6, LONG + " tail", "c"), (7, "one two three four five six", "é"),
    (7, "one two three four five six", "é"), (8, PASSAGE, "a"), (9, "before " + PASSAGE + " after", "a"), (10, "émigré 退款 😀 " * 30, "d"), (11, "\x00\x01 \x85 nbsp here", "d"), (-5, "negative id", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(queries.QUERIES[name], oracles.ORACLE_SQL[name])


# --------------------------------------------------------------------------- 1 chat

CALLS, RESULTS = "conv_id long, turn long, call_index int, call_id string, name string, arguments string, depends array<string>, role string", "conv_id long, turn long, call_id string, content string, name string"
TOOLS = {"sum": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True), "tags": ("array", False)}}


def test_chat_links_orders_and_checks(spark):
    rows = [
        (1, 0, 0, "c0", "sum", '{"b": 2.5, "a": 1}', None), (1, 2, 0, "c1", "say", '{"text": "é\\n\\"x\\"", "tags": ["b", "a"]}', ["c0", "c3"]), (1, 2, 1, "c2", "say", '{"text": 5}', ["c1"]), (1, 2, 2, "c3", "sum", '{"a": "1", "z": 0}', []),
        (1, 2, 3, "x1", "sum", '{"a": 1}', ["x2"]), (1, 2, 4, "x2", "sum", '{"a": 1}', ["x1"]), (1, 3, 0, "c4", "none", "{}", ["c9", "c5"]), (1, 5, 0, "c5", "sum", "no json", ["c5"]), (2, 0, 0, None, None, None, None), (None, 1, 0, "c0", "sum", '{"a": 1}', None),
    ]
    calls = spark.createDataFrame([(*r, "clash") for r in rows], CALLS)
    results = spark.createDataFrame([(1, 4, "c0", "later", "x"), (1, 1, "c0", "first", "x"), (1, 3, "c1", None, "x"), (1, 9, "zz", "orphan", "x"), (2, 1, None, "lost", "x")], RESULTS)
    got = {(r.conv_id, r.call_id): r for r in chat.link(calls, results, TOOLS).collect()}
    assert len(got) == len(rows)
    g = lambda c: got[1, c]
    assert g("c0").status == "ok" and json.loads(g("c0").message) == {"arguments": {"a": 1, "b": 2.5}, "id": "c0", "name": "sum", "result": "first", "turn": 0}
    assert g("c0").message == '{"arguments":{"a":1,"b":2.5},"id":"c0","name":"sum","result":"first","turn":0}'
    assert (g("c1").status, g("c1").level, g("c3").level, g("c2").level) == ("ok", 1, 0, 2) and g("c1").linked
    assert g("c2").errors == ["text is no string"] and g("c3").errors == ["a is no integer", "unexpected z"]
    assert g("x1").errors == g("x2").errors == ["circular"] and g("c4").errors == ["unknown tool none", "no call c9", "not earlier c5"]
    assert g("c5").errors == ["arguments are no object", "not earlier c5"] and json.loads(g("c5").message)["arguments"] == "no json"
    assert got[2, None].status == "invalid" and not got[None, "c0"].linked
    assert sorted(r.content for r in chat.orphans(calls, results).collect()) == ["lost", "orphan"]
    assert chat.link(calls.limit(0), results.limit(0), TOOLS).count() == 0
    order = sorted((r.turn, r.level, r.call_index, r.call_id) for r in got.values() if r.conv_id == 1 and r.turn == 2 and r.errors != ["circular"])
    assert [o[3] for o in order] == ["c3", "c1", "c2"]


def test_chat_reads_calls_from_messages(spark):
    texts = [("assistant", '{"tool_calls": [{"id": "a", "name": "sum", "arguments": {"a": 1}, "depends_on": []}]}'), ("tool", '{"tool_call_id": "a", "content": "3"}'), ("assistant", "plain"), ("user", None)]
    calls, results = chat.from_messages(spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    got = chat.link(calls, results, TOOLS).collect()
    assert [(r.call_id, r.status) for r in got] == [("a", "ok")] and json.loads(got[0].message)["result"] == "3"


def test_all_calls_of_a_conversation(spark):
    call = '{"tool_calls": [{"id": "a", "name": "count", "arguments": {"words": 1, "limit": 2}, "depends_on": ["b"]}, {"id": "b", "name": "read", "arguments": {"text": "x", "turn": "0"}}]}'
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "one two three"), (1, 2, "assistant", "first\nsecond"), (1, 3, "user", "one two"), (1, 4, "assistant", call), (1, 5, "tool", '{"tool_call_id": "a", "content": "3"}'), (1, 6, "tool", '{"tool_call_id": "z", "content": "lost"}'), (2, 4, "assistant", "alone"), (None, 0, "user", None)]
    calls, results = chat.all_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.call_id): r for r in chat.link(calls, results, chat.CHAT_TOOLS).collect()}
    g = lambda c: got[1, c]
    assert {k[1]: (r.level, r.status) for k, r in got.items() if k[0] == 1} == {"1:0:configure": (0, "unanswered"), "1:1:read": (0, "ok"), "1:1:count": (1, "invalid"), "1:1:reply": (2, "ok"), "1:3:read": (0, "unanswered"), "1:3:count": (1, "unanswered"), "1:3:reply": (2, "unanswered"), "a": (1, "ok"), "b": (0, "invalid")}
    assert g("1:1:count").errors == ["limit is no integer"] and g("b").errors == ["turn is no integer"] and json.loads(g("1:1:read").message)["result"] == "first"
    assert sorted((r.conv_id, r.call_id, r.status) for r in chat.orphan_rows(calls, results).collect()) == [(1, "z", "orphan"), (2, "2:3:configure", "orphan"), (2, "2:3:read", "orphan"), (2, "2:3:reply", "orphan")]
    assert chat.link(*[x.limit(0) for x in (calls, results)], chat.CHAT_TOOLS).count() == 0


# --------------------------------------------------------------------------- 2 quality, 4 toxicity


def auc(scores, labels):
    order = sorted(zip(scores, labels, strict=True))
    ranks = sum(k for k, (_, y) in enumerate(order, 1) if y)
    n = sum(labels)
    return (ranks - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize(("operator", "label", "fold", "least"), [(quality.quality, "quality", (4, 2), 0.97), (toxicity.toxicity, "toxic", (3, 1), 0.8)])
def test_classifiers_on_held_out_rows(spark, operator, label, fold, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, labels).collect()
    known = {r.doc_id: r[label] for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, known[r.doc_id]) for r in rows if r.doc_id in known and r.held_out]
    assert len(rows) == docs.count() and auc(*zip(*held, strict=True)) > least


@pytest.mark.parametrize(("operator", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_awkward_rows(spark, awkward, nothing, operator, label):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _, _) in enumerate(AWKWARD)] + [(4, None), (99, 1)], f"doc_id long, {label} int")
    rows = operator(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [None]
    assert operator(nothing, labels).count() == 0 and operator(awkward, labels.limit(0)).count() == len(AWKWARD)
    again = operator(awkward, labels).collect()
    assert sorted((str(r.doc_id), r.score) for r in rows) == sorted((str(r.doc_id), r.score) for r in again)


def test_toxic_misspellings_share_subwords():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ing", "st", "er", "nd", "ou"]) for _ in range(rng.randint(2, 5)))
    text = lambda bad: " ".join([word() for _ in range(60)] + (["vexgrum" + word() for _ in range(3)] if bad else []))
    rows = [(n, text(n % 4 == 0), int(n % 4 == 0)) for n in range(400)]
    scorer = toxicity.Scorer(toxicity.train(rows))
    s = scorer([text(False) for _ in range(50)] + ["plain the or " * 20 + " vexgrumzzz vexgrumqq"] + [None, ""])
    assert max(s[:50]) < 0.7 <= s[50] and s[51] == s[52] < 0.7
    assert toxicity.train([]).calibration.shape == toxicity.train([(1, "a", 1)]).calibration.shape


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert auc(model.score(x), y) > 0.97 and (0, 1) in {(a, b) for a, b, _ in model.pairs}
    single = quality.train(x, y, pairs=0)
    assert auc(single.score(x), y) < 0.7


# --------------------------------------------------------------------------- 3 suffix arrays


def repeats(rows, span=50):
    """Brute force: every window's smallest document."""
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < rank(i):
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(df, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **options).collect()), key=str)


def test_repeats_equal_brute_force(spark, awkward, nothing):
    assert removed(awkward) == repeats(AWKWARD)
    assert removed(nothing) == []
    rng = random.Random(5)
    pieces = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 90))) for _ in range(12)] + ["a" * 70, "ab" * 40, "\x00" * 60]
    rows = [(rng.randint(0, 60), "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 8))), "s") for _ in range(120)]
    want = repeats(rows)
    assert removed(frame(spark, rows)) == want
    assert removed(frame(spark, rows).repartition(3), batch_bytes=2000) == want


def test_repeats_carry_columns_and_whole_characters(spark):
    base = "é" * 40 + PASSAGE
    rows = [(1, base, "s"), (2, "xé" + base[1:], "t"), (3, None, "u"), (4, "short", None)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, rows), carry=("lang", "source", "n_chars")).collect()}
    assert got[1].kept_text == base and got[3].kept_text is None and got[4].kept_text == "short"
    assert got[2].kept_text.startswith("x") and PASSAGE not in got[2].kept_text
    assert {i: (r.lang, r.source) for i, r in got.items()} == {i: ("en", s) for i, _, s in rows}


def test_long_texts_are_cut_into_pieces_alike():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3_000_000).astype(np.uint8)
    offsets = np.array([0, 2_500_000, 3_000_000])
    blocks = suffix_dedup.Blocks.of(data, offsets, 50)
    covered = np.zeros(3_000_001, int)
    np.add.at(covered, blocks.first, 1)
    np.add.at(covered, blocks.last, -1)
    inside = np.cumsum(covered)[:-1]
    assert inside[:2_499_951].all() and not inside[2_499_951:2_500_000].any() and inside[2_500_000:2_999_951].all()
    moved = suffix_dedup.Blocks.of(data[1_000_000:], np.array([0, 2_000_000]), 50)
    own = {(s, b) for s, b, f in zip(blocks.seed.tolist(), blocks.body.tolist(), blocks.first.tolist(), strict=True) if 1_100_000 < f < 2_400_000}
    assert len(own - set(zip(moved.seed.tolist(), moved.body.tolist(), strict=True))) <= 6


def test_family_keeps_few_levels():
    family, rng, least = suffix_dedup.Family(), np.random.default_rng(3), {}
    for n in range(40):
        keys, doc = rng.integers(0, 500, (2, 30)).astype(np.uint64), np.full(30, 100 - n)
        for k in zip(*keys.tolist(), strict=True):
            least[k] = 100 - n
        family.insert(suffix_dedup.suffix_array((keys[0], keys[1]), doc))
    assert len(family.levels) <= 7
    asked = np.array([*least, (999, 1), (3, 10**6)], np.uint64).T
    got = family.scan((asked[0], asked[1]))
    assert got[:-2].tolist() == list(least.values()) and (got[-2:] == (1 << 63) - 1).all()


def test_family_answers_every_batch():
    family, rng, batches = suffix_dedup.Family(), np.random.default_rng(5), []
    for _ in range(23):
        n = int(rng.integers(0, 60))
        keys = rng.integers(0, 25, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint64)
        doc = rng.integers(0, 1000, n)
        batches.append((keys, doc, family.insert(suffix_dedup.suffix_array(keys, doc))))
    least, bodies = {}, collections.defaultdict(set)
    for keys, doc, _ in batches:
        for a, b, d in zip(*(k.tolist() for k in keys), doc.tolist(), strict=True):
            least[a, b] = min(least.get((a, b), 9999), d)
            bodies[a].add(b)
    for keys, _, number in batches:
        docs, mixed = family.answers(number)
        pairs = list(zip(*(k.tolist() for k in keys), strict=True))
        assert docs.tolist() == [least[p] for p in pairs] and mixed.tolist() == [len(bodies[a]) > 1 for a, _ in pairs]


# --------------------------------------------------------------------------- 5 mixing


def water_level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    stopped = {}
    while True:
        rest = [s for s in names if s not in stopped]
        level = (share * sum(sizes.values()) - sum(stopped.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return {**stopped, **{s: level * weight[s] for s in rest}}
        stopped.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_its_targets(spark, awkward, seed):
    rng = random.Random(seed)
    rows = [(n, "w " * rng.randint(0, 30), rng.choice(["a", "b", "é", "Z", None, "hot", "hot"])) for n in range(600)] if seed else AWKWARD
    df = frame(spark, rows) if seed else awkward
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len([w for w in (t or "").encode().split()])
    want, taken = water_level(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size) and len(r.positions) * r.size == r.taken
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in r.positions)
        taken[r.source] += r.taken
    largest = max(len((t or "").split()) for _, t, _ in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)


def test_training_stream_reads_rows_not_ids(spark):
    rows = [(7, "a b c", "s"), (7, "a b c", "s"), (7, "d e f g", "s"), (None, "n n", "s"), (None, "n n", "t"), (None, None, None), (8, "x y z w", "t"), (9, "", "t")]
    df = frame(spark, rows).withColumnRenamed("extra", "position").withColumnRenamed("row", "positions").withColumn("_row", F.lit(1))
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r.size] += len(r.positions)
    got = mixing.training_stream(df)
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, r.source, len((r.text or "").split())) for r in got.collect()) == +want
    assert mixing.training_stream(df.limit(0)).count() == 0


def test_mix_edges_and_stream(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None), (2, "", "x")])).collect()] == [0, 0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs).select("doc_id", "positions").collect()
    want = [i for _, i in sorted((p, r.doc_id) for r in mixed for p in r.positions)]
    assert [r.doc_id for r in mixing.training_stream(docs).collect()] == want and mixing.training_stream(docs).columns == docs.columns


# --------------------------------------------------------------------------- 6 packing


def check_pieces(rows, pieces):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x, *_ in rows}
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    copies = collections.Counter(i for i, *_ in rows)
    for i, own in by.items():
        assert collections.Counter(k for p in own for k in range(p.start, p.start + p.length)) == {k: copies[i] for k in range(len(ids[i]))}
    assert set(by) == set(ids)
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(p.length for p in pieces), len(sequences)


def test_packing_round_trip(spark, awkward, nothing):
    check_pieces(AWKWARD, packing.pack(awkward, tokenizer_path("word_bpe_49k.json")).collect())
    assert packing.pack(nothing, tokenizer_path("word_bpe_49k.json")).count() == 0
    rows = [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens, windows = check_pieces(rows, packing.pack(frame(spark, rows).coalesce(1), tokenizer_path("word_bpe_49k.json")).collect())
    assert windows * 2048 <= 1.03 * tokens


def test_packing_starts_from_the_least_count_at_every_size():
    rng = random.Random(13)
    for n in (1, 2, 20, 31, 32, 33, 70, 300):
        sizes = [512] * (4 * n)  # whole windows without a gap
        assert len({p[3] for p in packing.pack_lengths(sizes)}) == n
        mixed = [rng.randint(1, 700) for _ in range(8 * n)]
        used = len({p[3] for p in packing.pack_lengths(mixed)})
        assert -(-sum(mixed) // 2048) <= used <= -(-sum(mixed) // 2048) + max(1, n // 30)


def test_words_equal_the_tokenizer():
    from quillmere.llm.tokens import Words

    e = Words(tokenizer_path("word_bpe_49k.json"), keep=20)
    for x in ["It's DON'T we'll", "a..b, c., d,. ,. É ÉTÉ. <|endoftext|> x<|endoftext|>, ΣΑΣ Σ. İstanbul Ǆ 12,3 ﬁ éa.", "<|ENDOFTEXT|> A", "日本語。テスト, x　y z\x1cq\x85r", "'s 's. ''ll, l'été. ª º ⅷ", "", "\x00 a\x00b _,", "w" * 5000 + " , . a"]:
        (_, ids, _), *_ = e.encode(pa.array([x]))
        assert ids.tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("windows", [1, 2, 3, 7])
def test_differencing_is_even(windows):
    rng = random.Random(windows)
    sizes = [rng.randint(1, 300) for _ in range(200)]
    sums = np.bincount(packing.differencing(sizes, windows), weights=sizes, minlength=windows)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 8


# --------------------------------------------------------------------------- 7 licences


def test_licences_on_awkward_rows(spark, awkward, nothing):
    assert licences.scan(awkward).count() == 0 and licences.scan(nothing).count() == 0
    apache = licences.TEMPLATES["Apache-2.0-header"]
    rows = [(1, "x\nReleased under the MIT license\ny", ""), (2, "intro\n\n" + apache.replace(". ", ".\n") + "\n\nend", ""), (3, "released under a licence", ""), (None, "RELEASED -- under the mit LICENSE!", ""), (4, apache[: len(apache) // 2], ""), (1, "Released under the MIT License.", "")]
    got = {(r.doc_id, r.licence): (r.dice, r.n_units) for r in licences.scan(frame(spark, rows)).collect()}
    assert got[1, "MIT"] == (1.0, 2) and got[2, "Apache-2.0-header"][0] == 1.0 and (None, "MIT") in got and not any(k[0] in (3, 4) and "header" in k[1] for k in got)


# --------------------------------------------------------------------------- 8 near duplicates


def groups(rows, words, num, den):
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, sa), (b, sb) in itertools.combinations([x for x in sets.items() if x[0] is not None], 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sa for y in sb):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted(((i, len(s), find(i) if i is not None else None) for i in sets for s in sets[i]), key=str)


def near(df, **options):
    rows = near_dup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def family(seed, n=60):
    rng = random.Random(seed)
    out, base = [], [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        out.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words), "s"))
    return out + [(n + k, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(80)), "s") for k in range(20)] + out[:1]


@pytest.mark.parametrize("options", [{"words": 3, "numerator": 85, "bands": 24}, {}])
def test_near_duplicates_equal_brute_force(spark, awkward, nothing, options):
    words, num = options.get("words", 5), options.get("numerator", 80)
    assert near(awkward, **options) == groups(AWKWARD, words, num, 100)
    assert near(nothing, **options) == []
    rows = family(1)
    want = groups(rows, words, num, 100)
    assert near(frame(spark, rows), **options) == want
    assert near(frame(spark, rows), block_shingles=1500, bucket_rows=5, **options) == want  # clusters and buckets over several blocks
    short = [(n, f"same {'words'[: n % 5 + 1]}", "s") for n in range(200)]
    assert near(frame(spark, short), block_shingles=1500, bucket_rows=7, **options) == groups(short, words, num, 100)


def test_bayes_bounds_and_signatures():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    same = (near_dup.signature(a, 1000) == near_dup.signature(b, 1000)).mean()
    assert abs(same - 800 / 1200) < 0.06
    assert near_dup.least_matches(100, 0.8, 1e-6) < 80 and near_dup.least_matches(100, 0.8, 1e-3) > near_dup.least_matches(100, 0.8, 1e-6)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 50), (50, 70), (9, 9), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 50, 50: 50, 70: 50, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
    star = {r.node: r.component for r in components(spark.createDataFrame([(5, k) for k in range(1000, 1400)] + [(1399, 2)], "a long, b long"), "t").collect()}
    assert star == {**{k: 2 for k in range(1000, 1400)}, 5: 2, 2: 2}


def test_chance_collisions_join_no_cluster():
    rng = np.random.default_rng(6)
    verifier = near_dup.Verifier(80, 100, 35, 5, 1e-6, 25)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.concatenate([base[:30], rng.integers(0, 1 << 63, 70).astype(np.uint64)]) for _ in range(40)] + [np.concatenate([base[:96], rng.integers(0, 1 << 63, 4).astype(np.uint64)]) for _ in range(3)]
    values = np.stack([near_dup.signature(s, 175) for s in sets]).astype(np.uint8)
    assert sorted(verifier.forest(np.full(43, 100), values, None)) == [(40, 41), (40, 42)]
    assert verifier.forest(np.full(43, 100), values, np.arange(43) % 2) == [(40, 41), (41, 42)]


# --------------------------------------------------------------------------- 9 fingerprints


def test_fingerprints_equal_brute_force(spark, awkward, nothing):
    assert fingerprints.fingerprints(nothing).count() == 0
    for rows, df in ((AWKWARD, awkward), ([(3, "only one", "s")], None)):
        df = df if df is not None else frame(spark, rows)
        got = sorted(fingerprints.fingerprints(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
        order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert len(got) == len(rows)
        by_id = collections.defaultdict(set)
        for k, (i, t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            q = len(t) // 4
            new = t[: len(t) - q] + following[:q]
            common = next((n for n, (x, y) in enumerate(zip(t, new, strict=False)) if x != y), min(len(t), len(new)))
            by_id[i].add((len(t), hashlib.sha256(new.encode()).hexdigest(), common))
        assert all((r.n_chars, r.edited_sha256, r.common_prefix_edited) in by_id[r.doc_id] for r in got)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = fingerprints.fingerprints(frame(spark, [(1, "one text", "s"), (2, "one text", "s"), (3, "another", "s")])).orderBy("doc_id").collect()
    assert same[0].fingerprint == same[1].fingerprint != same[2].fingerprint and same[0].near_next == 1.0


def windows(text):
    return {text[max(0, k - 12) : k] for k in range(1, len(text) + 1)}


def likeness(a, b):
    return 1.0 if a == b else len(windows(a) & windows(b)) / max(1, len(windows(a) | windows(b)))


def test_likeness_equals_brute_force(spark):
    rng = random.Random(11)
    letters = "".join(rng.choice("abcdefghij é") for _ in range(400))
    for n in (1, 2, 3, 4, 5, 11, 12, 13, 22, 23, 24, 25, 30, 40, 60):
        text, other = letters[:n], letters[: n - n // 4] + letters[300 : 300 + n // 4]
        for a, b in ((text, other), (text, text[: n - n // 4]), (text, letters[200 : 200 + n]), (text, text + "q")):
            got = fingerprints.Fingerprint(a).likeness(fingerprints.Fingerprint(b))
            exact = len(windows(a) | windows(b)) <= 64
            assert got == pytest.approx(likeness(a, b)) if exact else abs(got - likeness(a, b)) < 0.25
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order, off = sorted(docs), []
    for r in fingerprints.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        following = docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        off += [r.near_edited - likeness(docs[r.doc_id], fingerprints.edited(docs[r.doc_id], following)), r.near_next - likeness(docs[r.doc_id], following)]
    assert max(map(abs, off)) < 0.3 and abs(np.mean(off)) < 0.01


@pytest.mark.parametrize("n", [22, 23, 24, 25, 32])
def test_no_length_at_which_likeness_breaks(spark, n):
    rows = [(1, "abcdefghijklmnopqrstuvwxyz012345"[:n], "s"), (2, "", "s")]
    r = fingerprints.fingerprints(frame(spark, rows)).where("doc_id = 1").first()
    assert r.near_edited == pytest.approx((n - n // 4) / n)


def test_prefix_hashes():
    rng = random.Random(6)
    a = "".join(rng.choice("ab😀") for _ in range(400))
    b = a[:250] + "z" + a[251:]
    x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    assert x.common_extension(y) == 250 and x.common_extension(y, 251, 251) == 149 and x.common_extension(x, 3, 3) == 397
    for _ in range(300):
        i, j, n = rng.randrange(380), rng.randrange(380), rng.randint(1, 6)
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
    f = fingerprints.Fingerprint
    assert f(a).text == f(a).text and f(a).likeness(f(b)) > 0.7 and f(a).likeness(f("q" * 300)) == 0 and f("").likeness(f("")) == 1 and f("").likeness(f("a")) == 0
    assert int(x.windows(12)[16]) == x.span(5, 17) and int(x.windows(12)[3]) == x.span(0, 4) and len(x.windows(12)) == 400


# --------------------------------------------------------------------------- 10 vectors


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((700, 16)).round(2)
    v[100:160] = v[100]  # many equal vectors: ties
    rows = [(n - 40, [float(x) for x in v[n]], "clash", 1) for n in range(700)]
    rows += [(5000, None, "x", 1), (5020, [0.0] * 16, "x", 1), (5040, [float("nan")] * 16, "x", 1), (5060, [float("inf")] + [1.0] * 15, "x", 1), (5080, [None] + [1.0] * 15, "x", 1), (5100, [1.0, 2.0], "x", 1), (None, [1.0] * 16, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    want = {}
    for n in range(0, 700, 20):
        s = [(-sum((v[n] * v[m]).cumsum()[-1:]), m - 40) for m in range(700) if m != n]
        want[n - 40] = [i for _, i in sorted(s)[:20]]
    for options in ({}, {"shard_rows": 90, "block_queries": 9, "groups": 3}):
        got = collections.defaultdict(list)
        for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == want
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors.nearest(df.where("vec_id between 0 and 2"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]


def test_search_counts_a_vec_id_once(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 8)).round(3)
    rows = [(n, [float(x) for x in v[n]]) for n in range(60)]
    more = [(20, rows[20][1]), (20, [9.0] * 8), (7, rows[7][1]), (7, rows[7][1]), (9, [-9.0] * 8)]
    kept = {n: min([r[1] for r in rows + more if r[0] == n]) for n in range(60)}
    got = collections.defaultdict(list)
    for r in vectors.nearest(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
    for q in (0, 20, 40):
        want = sorted((-sum(np.add.accumulate(np.array(kept[q]) * np.array(kept[n]))[-1:]), n) for n in range(60) if n != q)
        assert got[q] == [(k + 1, n) for k, (_, n) in enumerate(want[:20])]


def test_bounds_hold():
    rng = np.random.default_rng(9)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    r = vectors.Rotation.make(64, v.mean(axis=0))
    guess, off = r.estimate(q, r.encode(v), 3.0)
    assert (np.abs(guess - q @ v.T) <= off).mean() > 0.995


# --------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kept = {r.doc_id: r for r in docs.collect()}, {}
    for name, stage in p.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert set(docs.columns) == set(p.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    clean = kept["toxicity"]
    scores = toxicity.score_texts(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    assert {r.doc_id for r in clean} == {r.doc_id for r in scores.collect() if r.score < 0.7} and all(r == before[r.doc_id] for r in clean)
    first = {i for i, _, c in groups([(r.doc_id, r.text) for r in clean], 5, 80, 100) if i == c}
    assert {r.doc_id for r in kept["near_dup"]} == first
    rows = [(r.doc_id, r.text) for r in kept["near_dup"]]
    sha = {i: h for i, _, _, _, h in repeats(rows)}
    cut = {r.doc_id: r for r in kept["suffix_dedup"]}
    assert set(cut) == set(sha) and sum(hashlib.sha256((r.text or "").encode()).hexdigest() == sha[i] for i, r in cut.items()) > 0.9 * len(cut)
    assert all(r.n_chars == len(r.text) for r in cut.values())
    counts = collections.Counter(r.doc_id for r in kept["mixing"])
    assert max(counts.values()) <= 2 and set(counts) <= set(cut)
    pieces = p.STAGES[4][1](spark, docs, sf).collect()
    check_pieces([(r.doc_id, r.text) for r in kept["mixing"]], pieces)


# --------------------------------------------------------------------------- labelled samples


def test_one_long_labelled_text_does_not_end_the_sample(spark):
    from quillmere.llm import labelled

    docs = frame(spark, [(k, "word " * (40_000 if k % 5 == 0 else 3), "") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    drawn = labelled.sample(docs, labels, "toxic", (1000, 999), 1000, 20_000)
    assert sorted(d for d, _, _ in drawn) == [k for k in range(40) if k % 5]
