"""Each operator against a plain version, on edge cases and on the small tables."""

import collections
import functools
import hashlib
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tabq.llm import chat, exact, lm, mixing, neardup, packing, quality, substrings, suffixes, toxicity
from tabq.llm.graph import components
from tabq.llm.queries import ORACLES, QUERIES
from tabq.llm.suffix import suffix_ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for x in ("documents", "conversations"):
        con.execute(f"create view {x} as select * from '{sf_dir}/{x}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = con.execute(ORACLES[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[order.index(c)] for c in cols)) for r in found.fetchall())


# 1


def test_exact_edges(make, edge_rows):
    got = exact.exact_dedup(make(edge_rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in edge_rows:
        groups[sha(t or "")].append(i)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256) for r in got) == sorted((i is None, i or 0, sha(t or "")) for i, t in edge_rows)
    for r in got:
        ids = groups[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_index_remembers(spark, make, tmp_path):
    path = str(tmp_path / "index")
    first = exact.DigestIndex(spark, path, buckets=3)
    assert {r.doc_id: r.keep_id for r in first.add(make([(1, "a"), (2, "b"), (3, "a")])).collect()} == {1: 3, 2: 2, 3: 3}
    again = exact.DigestIndex(spark, path)
    assert again.buckets == 3
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(make([(7, "a"), (8, "c"), (9, "c")])).collect()}
    assert got == {7: (3, False), 8: (9, False), 9: (9, True)}
    assert again.rows().count() == 3 and again.add(make([])).count() == 0


def test_index_knows_its_batches(spark, make, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "batches"), buckets=2)

    def answer(rows, batch=None):
        return sorted(((r.doc_id, r.keep_id, r.kept) for r in index.add(make(rows), batch=batch).collect()), key=repr)

    index.add(make([(20, "z")]), batch="one")  # the answer is lost
    assert answer([(20, "z")], "one") == [(20, 20, True)]
    assert answer([(30, "z"), (31, "y")], "two") == [(30, 20, False), (31, 31, True)]
    assert answer([(20, "z")]) == [(20, 20, False)]
    assert answer([(None, "n"), (None, "n")], "three") == [(None, None, True)] * 2
    assert answer([(5, "n"), (6, "n"), (None, "n")], "four") == [(5, None, False), (6, None, False), (None, None, False)]
    index._writing("broken")  # a driver is lost while it adds
    with pytest.raises(RuntimeError):
        index.add(make([(40, "q")]), batch="five")
    assert answer([(41, "q")], "broken") == [(41, 41, True)] and answer([(40, "q")], "five") == [(40, 41, False)]
    assert index.rows().count() == index.rows().select("digest").distinct().count()
    index.close()


def test_index_side_has_no_exchange(spark, make, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "plan"), buckets=4)
    index.add(make([(i, str(i)) for i in range(50)])).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = make([(1, "a")]).select(F.unhex(F.sha2("text", 256)).alias("digest"))
        plan = batch.join(index.rows(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


# 2


def plain_suffixes(rows, window=50):
    rows = [(-1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(first.get(b[k : k + window], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def suffix_rows(df):
    return sorted((-1 << 63 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [256, 2])
def test_suffixes(make, edge_rows, small, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    passage = "This very passage, of over fifty bytes, stands in many documents at once."
    rows = [r for r in edge_rows if r[0] not in (7, 8)] + small[:60] + [(100_000 + i, f"{i} {passage}{i * 7919}") for i in range(40)] + [(200_000, "ab" * 100), (200_001, "ba" * 90)]
    assert suffix_rows(suffixes.suffix_dedup(make(rows))) == plain_suffixes(rows)


def test_suffixes_of_nothing(make):
    assert suffixes.suffix_dedup(make([])).count() == 0


def test_bytes_decide_where_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(suffixes, "keys", lambda sums, start, stop, shift, group: np.zeros(len(start), np.uint64))
    one, other = b"a" * 60, b"b" * 60
    data = np.frombuffer(one + other + other + one, np.uint8)
    mine, windows, low = suffixes.compared(np.full(4, 7, np.uint64), np.arange(4), np.full(4, 60), data)
    assert (list(mine), list(windows), list(low)) == ([2, 3], [11, 11], [1] * 11 + [0] * 11)


@pytest.mark.parametrize("at_once", [100, 1 << 21])
def test_groups_follow_from_the_bytes(small, monkeypatch, at_once):
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    texts = [t or "" for _, t in small[:20]]
    block = suffixes.Block(pa.record_batch({"doc_id": pa.array(range(20)), "text": pa.array(texts, pa.large_string())}), 40)
    f = block.fragments()
    f = block.split_hot(f, np.unique(f.anchor[::3]))
    hot, n = f.group != f.anchor, f.last - f.start + suffixes.WINDOW
    assert 0 < hot.sum() < len(hot)
    data = block.data[suffixes.ranges(f.start, n)]
    assert list(suffixes.groups_of(data, np.cumsum(n) - n, n, f.shift, hot, np.uint64(24))) == list(f.group)


def test_fragments_of_a_block_are_the_same_by_bytes():
    block = suffixes.Block(pa.record_batch({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["a" * 60, "a" * 60, "b" * 60], pa.large_string())}))
    zero, docs = np.zeros(3, np.int64), np.array([1, 2, 3])
    f = suffixes.Fragments(docs * 60 - 60, docs * 60 - 50, zero.view(np.uint64), zero.view(np.uint64), zero, zero.view(np.uint64), docs)
    assert list(block.alike(f)[1]) == [True, False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=6))
def test_suffix_ranks(texts):
    symbols = np.concatenate([np.array([*t, 0]) for t in texts])
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    got = suffix_ranks(symbols, bounds)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        t = [*t, 0]
        order = sorted(range(len(t)), key=lambda k: t[k:])
        assert [order[x] for x in range(len(t))] == list(np.argsort(got[a:b]))


# 3


def test_packing(make, edge_rows):
    from tokenizers import Tokenizer

    vocabulary = packing.vocabulary()
    tokenizer = Tokenizer.from_str(vocabulary)
    extra = [(20 + i, t) for i, t in enumerate(["It's 'tis, don't!!! ..x", "<|endoftext|> a<|endoftext|>b", "İSTANBUL ΣΑΣ Straße", "é x́.", "12 ½ a_b __", "WORD, word. Word,, word.)", "x" * 3 + "\x1d" + "y"])]
    rows = [(k, t) for k, (_, t) in enumerate(edge_rows + extra)]
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    got = packing.pack(make(rows), vocabulary, size=4096).collect()
    seen, sequences = collections.Counter(), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(make([]), vocabulary).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ.,!'\u0301\u0130\u03a3\u095d\u0958 \t\x1c")), max_size=12), max_size=4))
def test_ids_are_the_tokenizers(texts):
    want = [e.ids for e in cache().tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache().encode(texts)] == want


def test_ids_of_every_letter():
    """Each character that is a letter or has another form, as a word, before and after marks and letters."""
    chars = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    chars = [c for c in chars if unicodedata.normalize("NFC", c).lower() != c or (c.isalpha() and ord(c) < 0x3000)]
    for form in ("{}.", "a{}.", "{}a,", "A{}!?"):
        texts = [form.format(c) for c in chars]
        want = [e.ids for e in cache().tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in cache().encode(texts)] == want


@functools.cache
def cache():
    return packing.WordCache(packing.vocabulary(), most=1 << 14)


def test_word_cache_is_bounded():
    small = packing.WordCache(packing.vocabulary(), most=10_000)
    for n in range(40):
        small.encode([" ".join(f"w{chr(97 + n % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}," for k in range(50)) + " " + "x" * 5000])
    held = sum(packing.ENTRY + len(c) + len(v) for x in (small.known, small.old) for c, v in x.items())
    assert held < 2 * 10_000 + 60 * 400 and max(map(len, small.known)) <= packing.LONGEST


def test_level_packer_takes_the_best_level():
    packer = packing.LevelPacker(10, lambda w: None)
    for n in (4, 4, 7, 3):
        packer.place((0, 0, bytes(4 * n), n))
    for n in range(1, 10):
        counts = packer.count.copy()
        h = packer.level_for(n)

        def grown(level, n=n, counts=counts):
            c = counts.copy()
            c[level] -= level > 0
            c[level + n] += level + n < 10
            return int((c[1:10] ** 2).sum())

        assert grown(h) == min(grown(x) for x in range(0, 11 - n) if x == 0 or counts[x])


# 4


def test_mixing_edges(make, edge_rows):
    docs = make([(i, t, ["b", None, "a"][k % 3]) for k, (i, t) in enumerate(edge_rows)])
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    again = mixing.mix_documents(docs.repartition(5))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))
    assert max(collections.Counter(map(repr, out.where("doc_id = 7").collect())).values(), default=0) <= 2
    assert mixing.mix_documents(make([])).count() == 0


def test_mixing_meets_its_targets(make):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5 if i % 2 else 0}") for i in range(6000)]
    docs = make(rows)
    sizes = mixing.sizes_of(docs)
    held = mixing.plan_mix(sizes, mixing.cycled((3, 1, 2))).repeats(sizes).collect()
    target, taken, size = {}, collections.Counter(), collections.Counter()
    for r in held:
        target[r.source] = r["__target"]
        taken[r.source] += r["size"] * r["__repeats"]
        size[r.source] += r["size"]
    total = 1.5 * sum(size.values())
    weights = dict(zip(sorted(size), [3, 1, 2, 3, 1], strict=False))
    open_, left, want = set(size), total, {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            open_.remove(s)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 7


# 5


def plain_substrings(rows, window=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    n = collections.Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i or 0, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def test_substrings(make, edge_rows, small):
    passage = " ".join(f"p{k}" for k in range(36))
    rows = edge_rows + small[:60] + [(1000 + i, " ".join(f"{i}u{j}" for j in range(i)) + f" {passage} {i}") for i in range(30)] + [(2000, "la " * 90), (2001, " ".join(f"q{k}" for k in range(40)) * 2)]
    got = substrings.substring_dedup(make(rows))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_substrings(rows)
    assert substrings.substring_dedup(make([])).count() == 0


def test_cover_is_a_difference_set():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


# 6


def test_chain_on_held_out_documents(spark, make):
    bad, good = ["scum", "moronic", "idiotae"], ["cloud", "stone", "river", "field", "tree"]
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        text = [good[k] + str(k) * (i % 2) for k in rng.integers(0, 5, 30)]
        toxic = i % 5 == 0
        if toxic:
            text[3] = bad[i % 3] + ["", "us", "a"][i % 2]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 7 > 0), int(toxic)))
    docs = make([*rows, (-1, None), (-2, ""), (-3, "river"), (-4, "scum " * 20_000)])
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1, 1), (401, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit_chain(docs, known)).collect()}
    assert [i for i, _, x in labels if i >= 400 and out[i].rejected != bool(x)] == []
    assert not out[-1].rejected and not out[-2].rejected and not out[-3].rejected and out[-4].rejected
    none = toxicity.fit_chain(docs, known.limit(0))
    assert toxicity.score(docs, none).where("rejected").count() == 0
    assert toxicity.score(make([]), none).count() == 0


def test_chain_is_fitted_link_by_link():
    """Each link's model has no slope left on the features and the earlier links' out-of-fold probabilities, and predicts from them."""
    rng = np.random.default_rng(6)
    x = (rng.random((300, 5)) < 0.3).astype(float)
    first = (rng.random(300) < 1 / (1 + np.exp(1 - 2 * x[:, 0]))).astype(float)
    y = np.stack([first, (rng.random(300) < 0.1 + 0.6 * first).astype(float), (rng.random(300) < 0.2 + 0.5 * x[:, 1]).astype(float)], axis=1)
    fold = np.arange(300) % toxicity.FOLDS
    chain = toxicity.Chain.fit(list("abc"), {f"=w{c}": k for k, c in enumerate("abcde")}, x, y, fold)
    seen = x
    for k, model in enumerate(chain.models):
        p = 1 / (1 + np.exp(-(seen @ model.weights + model.bias)))
        assert np.abs(seen.T @ (y[:, k] - p) - model.weights).max() < 1e-4 and abs((y[:, k] - p).sum()) < 1e-4
        out = np.zeros(300)
        for f in range(toxicity.FOLDS):
            own = toxicity.Linear.fit(seen[fold != f], y[fold != f, k])
            assert np.abs(seen[fold != f].T @ (y[fold != f, k] - own.predict(seen[fold != f])) - own.weights).max() < 1e-4
            out[fold == f] = own.predict(seen[fold == f])
        seen = np.hstack([seen, out[:, None]])
    got = chain.predict(["Wa wb", "", "we"])
    for words, row in zip([(0, 1), (), (4,)], got, strict=True):
        values = [float(k in words) for k in range(5)]
        for model, p in zip(chain.models, row, strict=True):
            z = model.bias + sum(w * v for w, v in zip(model.weights, values, strict=True))
            assert p == pytest.approx(1 / (1 + np.exp(-z)))
            values.append(p)


# 7


def test_chat_round_trip(spark):
    texts = ["", None, "<|end|>", "<|user|>hi", "\\", "|\\|", "a<", "\\|>", "é\n日本", "\\### Assistant: </turn> ok", "x" * 200_000]
    rows = [(c, n, role, texts[(c + n) % len(texts)]) for c in range(11) for n, role in enumerate(["system", "user", "assistant", "user", "assistant"][: 1 + c % 5])]
    rows += [(50, 0, "assistant", "only"), (51, None, None, "x"), (51, 0, "user|>", "y"), (52, 1, "user", "t"), (52, 1, "user", "t"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("k", F.lit(2))
    made = chat.examples(turns)
    assert made.where("target is not null").count() == sum(r[2] == "assistant" for r in rows)
    by = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    for r in chat.digests(made).collect():
        said = by[r.conv_id]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat.digests(made).count() == len(by) and chat.examples(turns.limit(0)).count() == 0


# 8


def test_quality_metrics(make, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None] + [(30, "a b c d e f a b c d e g a b c d e"), (31, "x\nx\n\nx \n y\ny"), (32, "la " * 200), (33, "# $ & <> || **")]
    for r in quality.judge(make(rows)).collect():
        text = next(t for i, t in rows if i == r.doc_id) or ""
        w = WORD.findall(text)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        mark = [False] * len(w)
        for k in range(len(w) - 4):
            if grams[tuple(w[k : k + 5])] > 1:
                mark[k : k + 5] = [True] * 5
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(mark))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * sum(mark) > 20 * len(w)) and (not r.kept or not r.base_failed)
    assert quality.judge(make([])).count() == 0


def plain_limits(values, groups):
    """Of each group (language, source): the least and largest allowed value, from sorted values."""

    def body(some):
        some = sorted(some)
        return [some[-(-len(some) * k // 100) - 1] for k in (1, 10, 90, 99)]

    every, out = body(values), {}
    for g in set(groups):
        own = [v for v, x in zip(values, groups, strict=True) if x == g]
        lang = body([v for v, x in zip(values, groups, strict=True) if x[0] == g[0]])
        n = len(own)
        q1, q10, q90, q99 = ((n * a + 50 * b + 50 * c) // (n + 100) for a, b, c in zip(body(own), lang, every, strict=True))
        out[g] = (q10 - 3 * max(4 * (q90 - q10), q10 - q1) // 4, q90 + 3 * max(4 * (q90 - q10), q99 - q90) // 4)
    return out


def test_thresholds_are_those_of_each_group(spark):
    """Mean word lengths under 1.28, for which sketches are exact: plain quantiles give the same limits, and they differ by group."""
    rng = np.random.default_rng(4)
    rows = [(i, ("en", "de")[i % 2], f"s{i % 6}", 100 + int(rng.integers(0, 3 + 4 * (i % 6))) + 9 * (i % 200 == 0)) for i in range(1200)]
    m = spark.createDataFrame(rows, "doc_id long, lang_key string, source_key string, word_len_c long")
    m = m.withColumns({k: F.lit(0).cast("long") for k in quality.METRICS if k != "word_len_c"})
    got = {(r.lang_key, r.source_key): (r.min_word_len_c, r.max_word_len_c) for r in quality.thresholds(quality.sketches(m)).collect()}
    assert got == plain_limits([r[3] for r in rows], [r[1:3] for r in rows])
    assert len(set(got.values())) > 3


def test_what_is_odd_depends_on_the_group(spark):
    """A text full of signs falls among prose and stays among formulas; the same holds for very short and long words."""
    prose, signs = "a word and then another one so that it is long enough", "a + b | c & d < e > f $ g % h # i * j | k & l"
    long = "internationalisation " * 3 + "counterrevolutionaries antidisestablishment overgeneralisations institutionalising compartmentalised disproportionately interchangeability notwithstanding"
    rows = []
    for i in range(400):
        rows.append((i, f"{prose} {i}", "en", "prose"))
        rows.append((1000 + i, f"{signs} {i}", "en", "formulas"))
        rows.append((2000 + i, f"{long} x{i}", "de", "law"))
    rows += [(5000, f"{signs} 5", "en", "prose"), (5001, f"{signs} 5", "en", "formulas"), (5002, f"{long} 5", "en", "prose"), (5003, f"{long} 5", "de", "law"), (5004, f"{prose} 5", "de", "law")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {i: kept[i] for i in range(5000, 5005)} == {5000: False, 5001: True, 5002: False, 5003: True, 5004: False}
    assert sum(not v for i, v in kept.items() if i < 5000) == 0


def test_sketch_buckets(spark):
    values = [0, 1, 127, 128, 129, 1000, 65_535, 65_536, 10**9, 2**40 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket(F.col("v"))).withColumn("top", quality.bucket_top(F.col("b")))
    got = df.orderBy("v").collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    for r in got:
        assert r.v <= r.top <= r.v * (1 + 1 / 64) + 1


# 9


def test_lm_scores(spark, make):
    rng = np.random.default_rng(1)
    wanted, other = ["sun", "moon", "star"], ["mud", "clay", "rock"]
    rows = [(i, " ".join((wanted if i % 2 else other)[k] for k in rng.integers(0, 3, 40))) for i in range(200)]
    docs = make([*rows, (300, None), (301, " "), (302, "never seen words"), (None, "sun moon"), (303, "sun " * 30_000)])
    labels = spark.createDataFrame([(i,) for i in range(1, 100, 2)] + [(None,)], "doc_id long")
    out = {r.doc_id: r for r in lm.cross_entropy_difference(docs, labels).collect()}
    assert len(out) == 205 and out[300].score is None and out[301].score is None and out[302].n_words == 3
    assert min(out[i].score for i in range(101, 200, 2)) > max(out[i].score for i in range(100, 200, 2))
    assert lm.cross_entropy_difference(make([]), labels).count() == 0
    assert lm.cross_entropy_difference(docs, labels.limit(0)).count() == 205


def plain_losses(rows, wanted):
    """Per document the mean losses of target and background, counted and divided one by one."""
    said = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    often = collections.Counter(w for _, ws in said for w in ws)
    said = [(i, [w if often[w] >= lm.MIN_COUNT else 0 for w in ws]) for i, ws in said]

    def counts(some):
        one, two, n = collections.Counter(), collections.Counter(), 0
        for ws in some:
            one.update(ws)
            one.update([1] * bool(ws))  # 1 stands for the beginning
            two.update(zip([1, *ws], ws, strict=False))
            n += len(ws)
        return one, two, n

    models = [counts([ws for i, ws in said if i in wanted]), counts([ws for _, ws in said])]
    out = {}
    for i, ws in said:
        mine, losses = counts([ws]), []
        for (one, two, n), has in zip(models, (i in wanted, True), strict=True):
            total = 0.0
            for a, w in zip([1, *ws], ws, strict=False):
                own1, own2, own_a, own_n = (mine[0][w], mine[1][a, w], mine[0][a], mine[2]) if has else (0, 0, 0, 0)
                p = (one[w] - own1 + lm.FLOOR_WEIGHT * lm.FLOOR) / (n - own_n + lm.FLOOR_WEIGHT)
                p = (two[a, w] - own2 + lm.BACKOFF * p) / (one[a] - own_a + lm.BACKOFF)
                total -= np.log(max(p, 1e-12))
            losses.append(total / len(ws) if ws else None)
        out[i] = (len(ws), *losses)
    return out


def test_lm_equals_a_plain_count(spark, sf_dir, small):
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    want = plain_losses(small, good)
    got = {r.doc_id: r for r in QUERIES["op9_lm_scoring"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for i, (n, target, background) in want.items():
        assert got[i].n_words == n
        if n:
            assert (got[i].loss_target, got[i].loss_background) == pytest.approx((target, background), abs=1e-9)


# 10


def plain_near(rows, shingle, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates(make, edge_rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, t) for i, t in edge_rows if i is not None]
    for i in range(60):
        text = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 9))):
            text[k] = f"n{rng.integers(0, 1000)}"
        rows.append((100 + i, " ".join(text)))
    rows += [(200 + i, f"short text {i % 4}") for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(make([*rows, (None, "one")]), shingle=2).collect()}
    assert got.pop(None) == (1, None)
    assert got == plain_near(rows, 2)


def test_an_id_with_several_texts_links_them(make):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, c), (8, b), (9, a + " z"), (7, c + " w")]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(make(order), shingle=2).collect()}
        assert got == {(i, 1) for i in (1, 2, 3, 7, 8, 9)}


def test_near_duplicates_of_nothing(make):
    assert neardup.near_duplicates(make([])).count() == 0


def test_near_signatures_reach_all_pairs_under_the_distance():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (200, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)] += 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100, 200: 200, 201: 200}
