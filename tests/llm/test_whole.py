"""The pipeline stage by stage, clashing names, lying containers, tokens of chats, accuracy on the driver's labels."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codexloom.llm import bpe, chat, common, media, ngram_join, packing, quality, queries, secrets, suffix_dedup, vocab
from codexloom.llm.common import Work
from tests.llm.test_small import ROWS, brute_components, brute_repeats, same, shingles

RNG = random.Random(23)
GOOD, BAD = "the quality of text is a matter of words and lines".split(), "CLICK!!! $$$ ### BUY&&& NOW%%% *** win".split()
CLASHES = "_score _spans _base _row _all _text _covered _copy _doc _tie keys text_ token_ids size bits hits".split()


def some(words, n):
    return " ".join(RNG.choice(words) + str(RNG.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus: good and bad texts, copies, a shared passage, a secret, nulls, empties, repeated rows, clashing columns."""
    folder = tmp_path_factory.mktemp("corpus")
    passage = some(GOOD, 40)
    rows = [(i, some(GOOD, 90)) for i in range(60)] + [(100 + i, some(BAD, 90)) for i in range(30)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (202, None), (203, ""), (203, ""), (None, some(GOOD, 20))]
    rows += [(210 + i, some(GOOD, 60) + " " + passage + " " + some(GOOD, 60)) for i in range(3)]
    rows += [(220, some(GOOD, 50) + " password = hunter2hunter2 " + some(GOOD, 20))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` double" for c in CLASHES)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[7.0 + k for k in range(len(CLASHES))]) for i, t in rows], schema)
    frame.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), frame, rows


def test_pipeline(spark, corpus):
    folder, frame, rows = corpus
    docs = frame
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).checkpoint()
        assert docs.columns == frame.columns and docs.schema == frame.schema
        assert all(r[c] == 7.0 + k for r in docs.collect() for k, c in enumerate(CLASHES))
        assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        kept[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.collect()}
    before, after = kept["quality"]
    assert not ids(after) & set(range(100, 130)) and len(ids(after) & set(range(60))) >= 57
    before, after = kept["near_duplicates"]
    want = brute_components([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None], 5, 80)
    assert ids(after) - {None} == {i for i, c in want.items() if i == c} and (None in ids(before)) == (None in ids(after))
    before, after = kept["repeats"]
    removed = {(i, n) for i, _, n, _, _ in brute_repeats([(r.doc_id, r.text) for r in before.collect()])}
    sizes = {r.doc_id: len((r.text or "").encode()) for r in before.collect()}
    assert all((r.doc_id, sizes[r.doc_id] - len((r.text or "").encode())) in removed for r in after.collect())
    before, after = kept["secrets"]
    assert all("hunter2" not in (r.text or "") for r in after.collect()) and "[secret]" in after.where("doc_id = 220").first().text
    assert [x for x in texts(after) if x[1] != 220] == [x for x in texts(before) if x[1] != 220]
    packed = corpus_pipeline.run(spark, folder).collect()
    v = vocab.vocabulary(P.path("word_bpe_49k.json"), "word")
    want = sorted([*np.frombuffer(v._library([r.text or ""])[0], "<u2").tolist(), 2] for r in docs.collect())
    got = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        got.setdefault((r.doc_id, r.sequence_id * 4096 + r.offset - r.start), []).extend(r.ids)
    assert sorted(got.values()) == want
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]


def test_stages_on_an_empty_table(spark, corpus):
    folder, frame, _ = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), folder).count() == 0


def test_taken_names_are_refused_or_kept(spark, corpus):
    _, frame, _ = corpus
    path = P.path("byte_bpe_multi_50k.tiktoken")
    model = quality.Model(b"", b"")
    for refused in (
        lambda: bpe.encode(frame, path, P.PATTERN),
        lambda: bpe.decode(frame, path, P.PATTERN, "token_ids", "keys"),
        lambda: quality.score(frame, model, out="_SCORE"),
        lambda: media.store_text(frame, media="keys"),
        lambda: media.describe(frame.withColumn("media", F.lit(None).cast("binary")).withColumn("codec", F.lit(1))),
        lambda: secrets.spans(frame, Work(spark, "t")),
    ):
        with pytest.raises(ValueError, match="names already"):
            refused()
    for df in (suffix_dedup.remove(spark, frame), secrets.redact(frame, Work(spark, "t")), ngram_join.keep_first(spark, frame)):
        assert df.schema == frame.schema and all(r._score == 7.0 and r._tie == 16.0 for r in df.collect())


# one block of 5,000 near copies, and frequent parts in unlike sets


def test_ngram_join_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(60)] = f"r{rng.random()}"
        rows.append((i, " ".join(w)))
    line = " ".join(f"licence{i}" for i in range(25))
    rows += [(10_000 + i, line + " " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(3, 40)))) for i in range(1500)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    big = [i for i in range(5000) if got[i] == 0]
    assert len(big) > 4000
    for i in rng.sample(range(5000), 40):  # no link of these between different components
        assert all(got[j] == got[i] for j in range(5000) if near(i, j))
    tails = list(range(10_000, 11_500))
    want = brute_components([(i, t) for i, t in rows if i >= 10_000][:300], 3, 80)
    assert all((got[a] == got[b]) == (want[a] == want[b]) or got[a] == got[b] for a in tails[:300:7] for b in tails[:300:11])


def test_keys_have_no_hot_constants():
    """Small sets of different shingles share no keys: an empty part is none."""
    rng = np.random.default_rng(3)
    for num in (80, 90):
        bands, seen = ngram_join.Bands(num, 100), {}
        for i in range(2000):
            for k in set(bands.keys(np.unique(rng.integers(0, 1 << 63, rng.integers(2, 30)).astype(np.uint64)))[0].tolist()):
                seen.setdefault(k, []).append(i)
        assert max(map(len, seen.values())) <= 2


# 3


def test_suffix_dedup_by_join(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FEW", -1)
    rows = [(i, t) for i, t, _ in ROWS] + [(50, "abc " * 80), (51, "x" + "abc " * 60)]
    same(set(suffix_dedup.digests(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), brute_repeats(rows))


def test_suffix_array_refuses_too_much():
    with pytest.raises(ValueError, match="too many"):
        suffix_dedup.suffix_array(np.ones(suffix_dedup.MOST + 1, np.int64), 1)


def test_long_periodic_text(spark):
    rows = [(0, "ab" * 400_000), (1, "c" + "ab" * 200), (2, "ab" * 300_000 + "z")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digests(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 800_000 - 2, 1: 400, 2: 600_000}


# 6


def test_lying_containers(spark):
    payload = bytes(range(192)) * 70
    whole = media.store(payload)
    nested = b"".join(struct.pack(">I4s", 8 * (3000 - i), b"moov") for i in range(3000))
    at = whole.index(b"stsz")
    many = whole[: at + 12] + struct.pack(">I", 0xFFFFFFFF) + whole[at + 16 :]
    at = whole.index(b"stsc")
    run = whole[: at + 12 + 12] + struct.pack(">I", 0xFFFFFFFF) + whole[at + 16 + 12 :]
    at = whole.index(b"stco")
    far = whole[: at + 12] + struct.pack(">I", 0xFFFFFF00) + whole[at + 16 :]
    bad = [None, b"", b"no container", nested, many, run, far, whole[:200]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([whole, *bad])], "id int, media binary")
    rows = {r.id: r for r in media.describe(frame).collect()}
    assert len(rows) == len(bad) + 1 and rows[0].codec == "raw " and rows[0].n_samples == 70 and rows[0].keyframes[-1].length == 6 * 192 and (rows[0].width, rows[0].height) == (0, 0)
    assert all(rows[i + 1].codec is None and rows[i + 1].keyframes is None for i in range(len(bad)))


def test_media_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, keys string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_media(spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in ROWS:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    same([tuple(r)[:5] for r in got], want)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature, tuple(r.keyframes)))
        assert r.duration == r.payload_bytes and r.codec == "raw " and sum(k.length for k in r.keyframes) == r.payload_bytes
    assert all(len(x) == 1 for x in by.values())


# 8


def test_quality_on_the_labels(spark):
    """Held-out rows of the driver's own labels: better than the larger class, and good rows rank above bad ones."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = queries.op8_quality(spark, d).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert right / len(rows) > max(len(good), len(bad)) / len(rows) and auc >= 0.85


# 9


def test_chat_tokens(spark):
    path = P.path("byte_bpe_50k.json")
    v = vocab.vocabulary(path, "blank")
    rows = [(c, i, ["user", "assistant"][i % 2], f"hello there {i if i < c % 3 + 1 else c} </turn> \\ é") for c in range(12) for i in range(4)]
    nodes, steps = chat.tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Work(spark, "t"), path)
    table = nodes.orderBy("offset").collect()
    at = 0
    for r in table:
        assert r.offset == at and len(r.tokens) == r["size"]
        at += r["size"]
        parts = chat.pieces(r.formatted, r.begin, r.end)
        assert v.tokenizer.decode(r.tokens, skip_special_tokens=False) == r.formatted
        if r.learn:
            assert v.tokenizer.decode(r.tokens[r.loss.first : r.loss.stop], skip_special_tokens=False) == parts[1]
        else:
            assert r.loss is None
    place = {(r.owner, r.depth): r for r in table}
    flat = [t for r in table for t in r.tokens]
    walks = {}
    for s in steps.collect():
        walks.setdefault(s.conv_id, {})[s.depth] = place[(s.owner, s.depth)]
    for walk in walks.values():
        path_tokens, last = [], walk[max(walk)]
        for d in sorted(walk):
            assert walk[d].position == len(path_tokens)
            path_tokens += walk[d].tokens
        # what the last node may attend to: its ancestors' intervals, then its own chain up to it
        start = min(walk[d].offset for d in walk if walk[d].owner == last.owner)
        seen = [t for a in (last.attends or []) for t in flat[a.start : a.stop]] + flat[start : last.offset + last["size"]]
        assert sorted(seen) == sorted(path_tokens)


# shared


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        common.checkpoint_root(Session())


def test_packing_null_and_repeated(spark):
    rows = [(None, "a b c"), (1, None), (1, None), (2, "x " * 300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"), 2, Work(spark, "t"), 64).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0) and sum(r.doc_id == 1 for r in got) >= 2
