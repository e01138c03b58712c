"""The operators against brute force on small fixtures, and on the cases their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.decontaminate import decontaminate
from tessera.llm.egojoin import vector_dedup
from tessera.llm.language import language_ids
from tessera.llm.licenses import license_scan
from tessera.llm.linededup import LineRuns, line_dedup
from tessera.llm.packing import pack
from tessera.llm.quality import quality_scores
from tessera.llm.simhash import near_links, simhash_dedup
from tessera.llm.tokencount import token_counts
from tessera.llm.toxicity import toxicity_scores

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS_MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECES_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def odd_texts():
    rng = random.Random(5)
    vocab = ["the", "Of", "and", "über", "ciónó", "x1", "don't", "É", "a", "ß", "中文", "word,", "\U0001F600", "é", "<|endoftext|>", "▁", " "]
    texts = [None, "", " ", "\n", "\n\n", "a", "A a", "<s> </s>", "\x00\x01", "word " * 3000]
    texts += ["".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\t", ". ", ""]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return texts + texts[-5:]


def documents(spark, texts=None, ids=None):
    """With clashing extra columns, null ids and repeated ids."""
    texts = odd_texts() if texts is None else texts
    ids = [None if i == 3 else i // 2 if i < 8 else i for i in range(len(texts))] if ids is None else ids
    rows = [(i, t, "en" if n % 2 else None, None, None, n, "k", "r", 1.5) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key string, fp string, score double").repartition(3)


def thue_morse(n):
    """The word and its complement."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_decontamination_equals_windows(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 20, 40])))) for i in range(30)]
    items += [("1", items[1][1]), ("x", None), (None, "w1 w2 w3"), ("same", "a a a a a a a a a a a a")]
    texts = [" ".join(rng.choice(vocab + ["a"]) for _ in range(rng.randint(0, 200))) for _ in range(60)] + [items[5][1] + "." + items[6][1].upper(), "a " * 500, None, ""]
    texts += [t[1] for t in items if t[1]]
    for n in (64, 512, 1024, 2048):  # words that polynomial hashes take for equal; short and long ones
        items.append((f"tm{n}", thue_morse(n)[0]))
        texts += [thue_morse(n)[1], thue_morse(n)[0], "x " + thue_morse(n)[1] + " y"]
    items += [(f"b{i}", "the same boiler plate stands here in all of them and item " + str(i)) for i in range(50)]
    texts += ["so: the same boiler plate stands here in all of them and item 7 " * 20, items[5][1] + " " + "z" * 3_000_000 + " z" * 400_000]
    docs = documents(spark, texts, list(range(len(texts))))
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[p : p + 8])].add(i)
    expect = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        ids = sorted(x for x in found if x is not None)
        expect[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2)
    for block_words in (2_000_000, 40):  # one block, several blocks
        rows = decontaminate(docs, bench, block_words=block_words).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == expect
        assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_hit for r in rows)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    long = [f"  Line number {i} that is long enough to be counted Ä{i}\t" for i in range(6)] + ["short"]
    texts = ["\n".join(rng.choice(long) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 8))) for _ in range(40)] + [None, "", "\n", long[0] * 2000]
    ids = [None, 3, 3, *range(3, len(texts))]
    texts = texts[: len(ids)]
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for d, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if d is None else d)
    expect = []
    for d, t in zip(ids, texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 5 or max(holders[key(x)]) == (-1 if d is None else d)]
        expect.append((-1 if d is None else d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for hot_parts in (4096, 2):  # looked up by broadcast, or joined
        rows = line_dedup(documents(spark, texts, ids), n_batches=5, hot_parts=hot_parts).select("document.*", "n_lines", "n_dropped", "kept").collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows) == sorted(expect)
        assert rows[0].asDict().keys() >= {"row", "key", "fp", "score"}


def test_line_runs_compact_and_hold_each_once(spark):
    runs = LineRuns(spark, buckets=2, fanout=2)
    for _ in range(2):
        for b in range(5):
            runs.add(spark.range(10).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(b).cast("long").alias("doc")))
    assert runs.table().count() == 50 and len(runs.levels) > 2
    runs.close()


def test_hash_of_spans_is_the_library_s():
    from tessera.llm._bytes import lanes, xxh64

    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 20_000, dtype=np.uint8)
    sizes = np.concatenate([np.arange(200), [2048, 2049, 5000]])
    starts = rng.integers(0, len(raw) - 5000, len(sizes))
    want = [xxhash.xxh64_intdigest(raw[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes)]
    assert xxh64(lanes(raw), starts, sizes, 42).tolist() == want


@pytest.mark.parametrize("path", [WORDS_MODEL, PIECES_MODEL])
def test_chunks_with_one_hash_stay_apart(monkeypatch, path):
    from tessera.llm import _chunkcache

    texts = [t or "" for t in odd_texts()]
    real = _chunkcache.span_hashes
    monkeypatch.setattr(_chunkcache, "span_hashes", lambda *a: real(*a) & np.uint64(63))
    from tessera.llm._bytes import text_column
    import pyarrow as pa

    model = _chunkcache.adapter(path)(path)
    for _ in range(2):
        ids, n = _chunkcache.ChunkCache(model).encode(*text_column(pa.array(texts)))
        whole = [model.model.encode(t, add_special_tokens=False).ids if path.endswith(".json") else model.model.encode(t) for t in texts]
        assert ids.tolist() == [i for x in whole for i in x] and n.tolist() == [len(x) for x in whole]


def test_unknown_tokenizers_are_refused_or_whole(spark, tmp_path):
    from tessera.llm._chunkcache import WholeModel, adapter

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert adapter(other) is WholeModel
    import tokenizers

    texts = [t or "" for t in odd_texts()]
    want = [len(x.ids) for x in tokenizers.Tokenizer.from_file(other).encode_batch(texts, add_special_tokens=False)]
    rows = token_counts(documents(spark, texts, list(range(len(texts)))), other).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(want))
    with pytest.raises(ValueError):
        adapter(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_very_long_texts_count_and_pack_whole(spark):
    import sentencepiece
    import tokenizers

    rng = random.Random(9)
    vocab = [t for t in odd_texts() if t and len(t) < 400]
    vocab += [f"{w}{rng.randrange(10**6):x}" for w in ("qu", "Ze", "ö") for _ in range(4_000)]
    texts = [thue_morse(n)[i] for n in (512, 1024, 2048) for i in (0, 1)] + [" ".join(rng.choice(vocab) for _ in range(300_000)), None, "short"]
    assert len(texts[6].encode()) > 2 << 20
    docs = documents(spark, texts, list(range(len(texts))))
    pieces = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECES_MODEL).encode([t or "" for t in texts])]
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PIECES_MODEL, table_size=64).collect()} == dict(enumerate(pieces))
    ids = [x.ids + [1] for x in tokenizers.Tokenizer.from_file(WORDS_MODEL).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for r in pack(docs, WORDS_MODEL).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("path", [WORDS_MODEL, PIECES_MODEL])
def test_token_counts_equal_the_library(spark, path):
    texts = odd_texts()
    rows = token_counts(documents(spark, texts, list(range(len(texts)))), path, limit=100, table_docs=20, table_size=16).collect()
    if path.endswith(".json"):
        import tokenizers

        ids = [len(x.ids) for x in tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    else:
        import sentencepiece

        ids = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len((t or "").encode()), n, n > 100) for i, (t, n) in enumerate(zip(texts, ids))}


def test_packing_is_a_round_trip(spark):
    import tokenizers

    texts, length = odd_texts(), 64
    rows = pack(documents(spark, texts, list(range(len(texts)))), WORDS_MODEL, length=length).collect()
    ids = [x.ids + [1] for x in tokenizers.Tokenizer.from_file(WORDS_MODEL).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length > 0
        assert np.frombuffer(bytes(r.ids), "<u2").tolist() == own
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, x in pieces.items():
        x.sort()
        assert [s for s, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(n for _, n in x) == len(ids[d])
    assert sorted(pieces) == list(range(len(texts))) and sorted(sequences) == list(range(len(sequences)))
    for k, x in sequences.items():
        x.sort()
        assert [s for s, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()]
        assert sum(n for _, n in x) == length or k == len(sequences) - 1


def slow_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(150)) for _ in range(12)]
    texts = odd_texts()
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    fps = [slow_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    expect = roots(len(fps), links)
    rows = simhash_dedup(documents(spark, texts, list(range(len(texts))))).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, expect))}
    assert len(set(expect)) < len(set(fps))


def test_simhash_blocks_lose_no_link(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    pairs = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 4, 1)).tolist()
    expect = roots(len(x), pairs)
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    got = {r.node: r.root for r in components(near_links(df, 4, block_rows=16)).collect()}
    groups = defaultdict(set)
    for v, i in place.items():
        groups[got.get(v, v)].add(expect[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expect))


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(300)}
    assert components(links.filter("a < 0")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 16))
    x = np.concatenate([centers + rng.normal(size=(20, 16)) * s for s in (0, 0, 0.05, 0.1, 0.12, 0.15, 0.2)] + [centers * 3])
    label = rng.integers(0, 3, len(x))
    vectors = [v.astype(np.float32).tolist() for v in x] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 16, [1.0] * 16, [1.0] * 3]
    labels_ = [*label.tolist(), 1, 1, 1, 1, 1, None, None, 1]
    n = len(x)
    unit = np.array(vectors[:n]) / np.linalg.norm(np.array(vectors[:n]), axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    expect = roots(n, np.argwhere(near).tolist()) + list(range(n, len(vectors)))
    links = near.sum(axis=1).tolist() + [0] * (len(vectors) - n)
    df = spark.createDataFrame([(i, v, y, "extra") for i, (v, y) in enumerate(zip(vectors, labels_))], "vec_id long, embedding array<float>, label int, class string").repartition(3)
    for block_rows in (2048, 5):
        rows = vector_dedup(df, block_rows=block_rows).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {i: (k, c, c == i) for i, (k, c) in enumerate(zip(links, expect))}
    assert sum(links) > 100
    near &= unit @ unit.T >= 1 - 1e-12  # tiny cells, of which there are very many
    same = {r.vec_id: r.n_links for r in vector_dedup(df, cosine=1.0 - 1e-12).collect()}
    assert [same[i] for i in range(n)] == near.sum(axis=1).tolist() and near.sum() >= 20


def test_licenses_equal_phrases(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rng = random.Random(8)
    parts = ["CC BY", "cc-by", "All rights reserved", "all rights", "GNU General Public License, version 3", "filler", "cc by cc by", "Released under the MIT License.", "general\npublic license"]
    texts = odd_texts() + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(30)]
    rows = {r.doc_id: r for r in license_scan(documents(spark, texts, list(range(len(texts))))).collect()}
    for d, t in enumerate(texts):
        w, at, found = words(t), [], set()
        for p, label in phrases.items():
            for i in range(len(w)):
                if w[i : i + len(p.split())] == p.split():
                    at.append(i)
                    found.add(label)
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))
        assert found <= set(r.labels.split(",")) | set() and 0 <= r.score <= 1
        if (t or "").count("Released under the MIT License"):
            assert "mit" in r.labels.split(",")


def test_license_notice_with_changed_words(spark):
    from tessera.llm.licenses import TEMPLATES

    text = next(t for label, t in TEMPLATES if label == "isc").replace("any purpose", "any good purpose").replace("is hereby", "hereby")
    r = license_scan(documents(spark, ["before " + text + " after"], [1])).first()
    assert "isc" in r.labels.split(",") and 0.6 <= r.score < 1 and r.places[0]["first"] == 1


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97
    other = language_ids(docs.withColumn("source", F.lit("z")).withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang"))))
    assert language_ids(docs).exceptAll(other).isEmpty()


def slow_phrases(text, corpus):
    """Longest phrases from left to right; a byte that the corpus lacks is one."""
    i = n = 0
    while i < len(text):
        size = 0
        while i + size < len(text) and text[i : i + size + 1] in corpus:
            size += 1
        i += max(1, size)
        n += 1
    return n


def test_parse_equals_longest_phrases():
    from tessera.llm import language

    rng = random.Random(4)
    known = {"x": b"abracadabra", "y": b"banana band", "z": bytes(rng.choice(b"abcdr ") for _ in range(700)), "w": b"z"}
    parser = language.Parser(known)
    clean = {k: re.sub(b" +", b" ", v) for k, v in known.items()}
    texts = [b"abrabananaqbandcad", b"", b" ", b"q", b"abra" * 5_000, bytes(rng.choice(b"abcdrnq ") for _ in range(12_000)), b"abracadabra" * 30, bytes(rng.choice(b"abn") for _ in range(257))]
    for piece in (1 << 20, 5_000):  # a text in one piece, or in several
        language.PIECE = piece
        try:
            got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        finally:
            language.PIECE = 1 << 20
        for k, name in enumerate(parser.languages):
            assert got[k].tolist() == [slow_phrases(re.sub(b" +", b" ", t), clean[name]) for t in texts]


def test_every_language_is_learned(spark):
    from tessera.llm.language import training_texts

    rng = random.Random(7)
    names = [f"l{i:03d}" for i in range(120)]
    alphabets = {n: [chr(rng.randrange(97, 123)) + chr(rng.randrange(0x400, 0x450)) + chr(rng.randrange(97, 123)) for _ in range(60)] for n in names}
    say = lambda n, m: " ".join(rng.choice(alphabets[n]) for _ in range(m))
    rows = [(i, say(n, 900 if k == 119 else 150), n) for i, (k, n) in enumerate((k, n) for k, n in enumerate(names) for _ in range(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(training_texts(docs, "doc_id", "text", "lang", (4, 2), 96_000, 2_000, 4_000, 256)) == names  # the last has long documents only
    found = language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len({r.lang for r in found}) > 96 and sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)


def test_quality_and_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    q = quality_scores(docs, known).join(known, "doc_id").filter("held_out").toPandas()
    assert (q["predicted"] == q["quality"]).mean() > 0.9
    t = toxicity_scores(docs, known).join(known, "doc_id").filter("held_out").toPandas()
    assert (t["predicted"] == t["toxic"]).mean() > 0.95
    # held-out labels don't count
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = known.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert np.allclose(sorted(toxicity_scores(docs, flipped).toPandas()["score"]), sorted(toxicity_scores(docs, known).toPandas()["score"]))


def test_classifiers_take_odd_rows(spark):
    docs = documents(spark)
    marks = [(i, i % 2, i % 3 == 0) for i in range(10, 60)] + [(None, 1, 1), (12, None, None), (13, 1, 1)]
    marks = [(i, q, None if t is None else int(t)) for i, q, t in marks]
    for known in (labels(spark), labels(spark, marks)):
        for frame in (quality_scores(docs, known), toxicity_scores(docs, known)):
            rows = frame.collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_all_take_empty_tables_and_odd_rows(spark):
    docs, n = documents(spark), documents(spark).count()
    bench = spark.createDataFrame([("1", "the Of and"), (None, None)], "item_id string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    run = [
        lambda d: decontaminate(d, bench), lambda d: line_dedup(d), lambda d: token_counts(d, PIECES_MODEL), lambda d: simhash_dedup(d),
        lambda d: license_scan(d), lambda d: language_ids(d), lambda d: quality_scores(d, labels(spark)), lambda d: toxicity_scores(d, labels(spark)),
    ]
    for f in run:
        assert f(docs).count() == n
        assert f(docs.filter("false")).count() == 0
    assert decontaminate(docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    assert pack(docs.filter("false"), WORDS_MODEL).count() == 0 and vector_dedup(vectors).count() == 0
    assert pack(docs, WORDS_MODEL).filter("start = 0").count() == n
    und = {r.lang_pred for r in language_ids(docs).join(docs.filter("text is null or text in ('', ' ')").select("doc_id"), "doc_id", "left_semi").filter("score = 0").collect()}
    assert "und" in und


def test_frequent_pre_tokens_come_from_all_documents(spark):
    from tessera.llm import tokencount

    path = public_tokenizers.path("piece_bpe_32k.model")
    late = ["zebra quagga okapi"] * 3000
    docs = documents(spark, ["one two three"] * 2500 + late, list(range(5500))).orderBy("doc_id")
    known = lambda d, *n: set(tokencount.frequent(d, "text", path, 65_536, *n))
    wanted = known(documents(spark, late, list(range(3000))), None)
    assert wanted <= known(docs, None) and not wanted <= known(docs, 2_000)


def slow_licenses(text, templates, k=5, drift=3, min_cover=0.6):
    """Labels and the best cover of a text, from all pairs of equal k-grams."""
    w, labels_, best = words(text), set(), 0.0
    for label, template in templates:
        t = words(template)
        size = min(k, len(t))
        hits = [(p, a) for a in range(len(t) - size + 1) for p in range(len(w) - size + 1) if w[p : p + size] == t[a : a + size]]
        places, last = [], None
        for d in sorted({p - a for p, a in hits}):
            if last is None or d - last > drift:
                places.append(set())
            places[-1].add(d)
            last = d
        for ds in places:
            cover = len({i for p, a in hits if p - a in ds for i in range(a, a + size)}) / len(t)
            if cover == 1 if len(t) < 8 else cover >= min_cover:
                labels_.add(label)
                best = max(best, cover)
    return ",".join(sorted(labels_)), best


def test_licenses_equal_brute_force(spark):
    from tessera.llm.licenses import PHRASES, TEMPLATES

    rng = random.Random(12)
    every = [*PHRASES, *TEMPLATES]
    texts = [None, "", "cc", "by " * 7, "CC BY " * 20_000]
    for _ in range(40):
        w = []
        for _ in range(rng.randint(1, 4)):
            part = words(rng.choice(every)[1])
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(part))
                part[i : i + rng.randint(0, 2)] = rng.sample(["the", "software", "zzz", "license", "of"], rng.randint(0, 2))
            w += part[rng.randint(0, 3) :] + ["filler"] * rng.randint(0, 5)
        texts.append(" ".join(w))
    rows = {r.doc_id: r for r in license_scan(documents(spark, texts, list(range(len(texts))))).collect()}
    assert rows[4].n_base == 20_000 and (rows[4].first_word, rows[4].last_word, rows[4].labels) == (0, 39_998, "cc-by")
    for d, t in enumerate(texts):
        if d != 4:
            labels_, best = slow_licenses(t, every)
            assert rows[d].labels == labels_ and abs(rows[d].score - best) < 1e-9


def test_nnpu_gradient_and_calibration():
    from tessera.llm._fit import isotonic
    from tessera.llm.toxicity import fit_nnpu

    rng = np.random.default_rng(3)
    x = (rng.random((400, 6)) < 0.3).astype(np.float32)
    positive = (x[:, 0] > 0) & (rng.random(400) < 0.5)
    # the first step of Adam is the sign of the risk's slope, taken here from differences of the risk
    rates, prior, decay = 0.05, 0.2, 1e-4

    def risk(w, b):
        g = x.astype(float) @ w + b
        gp, gu = g[positive], g[~positive]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return prior * np.logaddexp(0, -gp).mean() + negative + decay / 2 * (w @ w), negative

    w0 = np.random.default_rng(0).normal(0, 0.01, 6)
    assert risk(w0, -1.0)[1] > 0
    w1, b1 = fit_nnpu(x, positive, prior, steps=1, rate=rates, decay=decay)
    slope = [(risk(w0 + 1e-5 * np.eye(6)[i], -1.0)[0] - risk(w0 - 1e-5 * np.eye(6)[i], -1.0)[0]) / 2e-5 for i in range(6)]
    assert np.allclose(w1, w0 - rates * np.sign(slope), atol=1e-4)
    w, b = fit_nnpu(x, positive, prior, steps=400)
    score = x @ w + b
    assert score[x[:, 0] > 0].mean() > score[x[:, 0] == 0].mean() + 1 and np.isfinite(w).all()
    for _ in range(50):  # pooling neighbours is the least-squares fit: no non-decreasing one is better
        n = rng.integers(0, 5, 8).astype(float)
        n[0] += 1
        p = np.floor(rng.random(8) * (n + 1))
        fit = isotonic(n, p)
        loss = lambda f: (n * f * f - 2 * p * f).sum()
        grid = np.sort(rng.random((2_000, 8)), axis=1)
        assert (np.diff(fit) >= 0).all() and loss(fit) <= min(loss(f) for f in grid) + 1e-9


def test_quality_equals_numpy(spark):
    """Every step again on whole arrays: statistics, features, normal equations, calibration."""
    from tessera.llm._bytes import text_column
    from tessera.llm._fit import isotonic
    from tessera.llm.quality import BINS, Kernel, statistics

    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "Text.", "!!!", "x1", "spam"]) for _ in range(rng.randint(1, 80))) for _ in range(120)] + [None, ""]
    y = [int("!!!" not in (t or "!!!")[:40]) for t in texts]
    known = [(i, v, 0) for i, v in enumerate(y)] + [(3, 1, 0)]
    rows = {r.doc_id: r for r in quality_scores(documents(spark, texts, list(range(len(texts)))), labels(spark, known)).collect()}
    y[3] = max(y[3], 1)
    x = statistics(*text_column(pa.array(texts, pa.string()))).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))])
    y, a, c = np.array(y, float), fold >= 2, fold == 1
    kernel = Kernel(x[a].mean(axis=0), x[a].std(axis=0), 256, 6.0, 11)
    z = kernel(x)
    w = np.linalg.lstsq(np.vstack([z[a], np.sqrt(1e-3 * a.sum() + 1e-6) * np.eye(257)]), np.concatenate([y[a], np.zeros(257)]), rcond=None)[0]
    place = np.clip((z @ w + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
    rates = isotonic(np.bincount(place[c], minlength=BINS), np.bincount(place[c], weights=y[c], minlength=BINS))
    close = [abs(rows[i].score - rates[place[i]]) < 1e-6 for i in range(len(texts))]
    assert np.mean(close) > 0.98  # a value on a bin's edge may fall to either side
    assert all(rows[i].held_out == (fold[i] == 0) and rows[i].predicted == (rows[i].score >= 0.3) for i in rows)
