"""The ten operators and the pipeline against brute force, with odd rows in every table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

pytest.importorskip("recollect.llm")

import corpus_pipeline  # noqa: E402
from recollect.llm import blocks, byte_bpe, language_id, license_scan, linear, media, packing, quality_classifier, quality_rules, queries, simhash, token_counts, toxicity  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words string"
WORDS = "the quick brown fox jumps over a lazy dog near river banks while seven wise owls watch from tall old trees".split()
ODD = [
    None,
    "",
    " ",
    "\n\n \t",
    "one",
    "two words",
    "  double  spaces \n and\ttabs  ",
    "Tab\x1cand control\x00 chars \x85 nel",
    "<s> </s> <|endoftext|> <|startoftext|> <|ENDOFTEXT|> <unk> <0x41>",
    "▁marks ▁▁ and 中文字符 ümläut ÀÉ \U0001f600 ﬁ İ Σας",
    "é combining İ 'S 'll don't WE'RE 12345 1a2b",
    "x" * 5000,
    "é" * 3000,
    "MIT License. Apache-License mit license; general public licenses, GNU General Public License",
    "you idiot, stupid and worthless trash",
    " ".join(WORDS) + " " + " ".join(WORDS) + "\n" + " ".join(WORDS),
]


def rows():
    rng = np.random.default_rng(3)
    out = [(i, t, "en" if i % 2 else None, None, None, None, "clash") for i, t in enumerate(ODD)]
    out += [(i, t, "en", "s", 1, 0.5, "clash") for i, t in enumerate(ODD)][-3:]  # repeated rows
    out += [(None, "a null id", "de", None, 1, 1.0, None), (None, "a null id", "de", None, 1, 1.0, None), (None, None, None, None, None, None, None)]
    for i in range(100, 160):
        words = rng.choice(WORDS, rng.integers(1, 120))
        out.append((i, " ".join(words).capitalize() + ".", ("en", "de")[i % 2], "s", 5, None, "z"))
    out.append((200, " ".join(rng.choice(WORDS, 40_000)), "en", "s", 9, None, "z"))
    base = rng.choice(WORDS, 400)
    for i in range(300, 330):
        near = base.copy()
        near[i - 300] = "changed"
        out.append((i, " ".join(near), "en", "s", 9, None, "z"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, i % 2, int(i % 3 == 0)) for i in range(100, 160)] + [(None, 1, 1), (101, None, None), (100, 1, 0), (9999, 0, 1)]
    return spark.createDataFrame(made, "doc_id bigint, quality int, toxic int")


TEXTS = [r[1] for r in rows()]


def by_text(df, docs, *cols):
    """Results by (id, text): every operator is a function of these."""
    return sorted(map(tuple, df.select("doc_id", *cols).collect()), key=repr)


def expected(f):
    return sorted([(r[0], *f(r[1] or "")) for r in rows()], key=repr)


def test_license_base_columns(docs, none):
    def brute(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at, found = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            found |= {label} if hits else set()
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))

    assert by_text(license_scan.find(docs), docs, "n_words", "n_base", "first_word", "last_word", "base_labels") == expected(brute)
    assert license_scan.find(none).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0-notice"),
        ("Licensed under the Apache License, Version 1.1.", "apache"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-notice"),
        ("licensed under the terms of the GNU Affero General Public License as published, version 3", "gpl,gpl-notice"),
        ("licensed under the GNU General Public License one two three four version 3", "gpl"),
        ("Released under the MIT License.", "mit,mit-notice"),
        ("Licensed under CC BY-NC 4.0.", "cc-notice"),
        ("all rights are reserved", ""),
    ],
)
def test_license_templates(text, labels):
    automata = [license_scan.Automaton(*t) for t in license_scan.TEMPLATES]
    base = [(p.encode().split(), label) for p, label in license_scan.BASE]
    assert license_scan.scan(text, automata, base)[5] == labels


def test_license_markup_errors():
    with pytest.raises(ValueError):
        license_scan.Automaton("x", "a", "a <<beginOptional>> b")
    with pytest.raises(ValueError):
        license_scan.Automaton("x", "b", "a <<beginOptional>> b <<endOptional>>")


def brute_statistics(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    mark = set()
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            mark.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark), len(w) < 20 or 100 * len(mark) > 30 * len(w)


def test_quality_rules(docs, labels, none):
    model = quality_rules.train(docs, labels)
    got = quality_rules.assess(docs, model)
    assert by_text(got, docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected(brute_statistics)
    assert got.where("base_failed AND kept").count() == 0
    empty = quality_rules.train(none, labels)
    assert quality_rules.assess(none, empty).count() == 0
    assert quality_rules.assess(docs, empty).where("kept = base_failed").count() == 0


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    brute = lambda t: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    assert by_text(token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model")), docs, "n_bytes", "n_tokens", "over_limit") == expected(brute)
    assert token_counts.count(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert not token_counts.splittable(["▁a", "a▁b"])


def test_token_counter_memo_is_bounded():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    c = token_counts.Counter(proto, token_counts.whole_tokens(proto), memo=5)
    texts = [f"qzx{i} wvk{i}" for i in range(20)]
    one = [n for t in texts for n in c.counts([t])]
    assert one == [len(x) for x in c.sp.encode(texts)]


def test_byte_bpe(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def brute(t):
        ids = enc.encode_ordinary(t)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    for most in (1 << 17, 20):  # all words folded in Spark; nearly all merged in the stage
        got = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, with_ids=True, most=most)
        assert by_text(got, docs, "n_tokens", "ids_sha256", "decoded_sha256") == expected(brute)
    assert byte_bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_merge_is_the_short_merge():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(1)
    for _ in range(200):
        word = bytes(rng.choice(list(b"abcdehinot"), rng.integers(2, 60)).tolist())
        if word not in ranks:
            assert byte_bpe._merge_long(word, ranks) == byte_bpe.merge(word, ranks)


def brute_fingerprint(t):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints):
    """Component of each fingerprint by comparing all pairs."""
    known = sorted(set(prints))
    root = {p: p for p in known}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in known}


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, none, bucket):
    prints = {t: brute_fingerprint(t) for t in {t or "" for t in TEXTS}}
    root = brute_components(prints.values())
    least = {}
    for r in rows():
        c = root[prints[r[1] or ""]]
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = expected(lambda t: (f"{prints[t]:016x}", least.get(root[prints[t]])))
    assert by_text(simhash.near_duplicates(docs, bucket=bucket), docs, "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(docs, bucket=bucket)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))
    assert simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("bucket", [64, 3, 0])
def test_simhash_links_on_clusters(spark, bucket):
    rng = np.random.default_rng(bucket)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    some = set(base)
    for _ in range(300):
        some.add(int(rng.choice(base)) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(nodes, bucket)
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(edges).collect()}
    want = brute_components(some)
    same = collections.defaultdict(set)
    for p in some:
        same[want[p]].add(got.get(p, p))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(docs, path)
    want, total = [], 0
    for r in rows():
        ids = np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want += [(r[0], k, b, len(ids[b : b + 2048]), zlib.crc32(ids[b : b + 2048].tobytes())) for k, b in enumerate(range(0, len(ids), 2048))]
    assert by_text(got, docs, "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    bins = collections.defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack(none, path).count() == 0


def test_packing_plan_places_everything_and_search_helps():
    rng = np.random.default_rng(0)
    for low, high in ((1, 2048), (600, 1100), (400, 1500)):
        lengths = collections.Counter(int(x) for x in rng.integers(low, high, 500))
        first = packing.best_fit(dict(lengths))
        plan = packing.plan(dict(lengths))
        placed = collections.Counter()
        for b, n in plan.items():
            assert sum(b) <= 2048
            for x in b:
                placed[x] += n
        assert placed == lengths
        assert sum(plan.values()) <= sum(first.values())
    assert len(packing.local_search([[1500], [1500], [500], [500]])) == 2
    assert packing.plan({}) == {}


def test_packing_plan_saves_the_same_share_at_any_size():
    for n in (300, 3000, 30_000):
        mix = {800: n, 700: n, 548: n}
        plan = packing.plan(mix)
        assert sum(packing.best_fit(mix).values()) == n * 7 // 6
        assert plan == {(800, 700, 548): n}


def test_media(docs, none):
    def brute(t):
        b = t.encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        w = media.wav(p)
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(w), hashlib.sha256(w).hexdigest(), media.features(p)

    got = media.media_columns(docs, with_media=True)
    assert by_text(got, docs, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == expected(brute)
    assert media.media_columns(none).count() == 0


def test_media_chunks_are_shared_and_verified(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(rng.choice(WORDS, 3000))
    d = spark.createDataFrame([(i, f"{i} " * 50 + passage + f" {i}" * 50) for i in range(4)], "doc_id bigint, text string")
    seen = media.digests(d)
    foreign = media.foreign_chunks(seen.select("item", "chunks"))
    assert foreign.count() > 3
    stored = media.store(d, foreign)
    held = sum(len(r.own) for r in stored.collect())
    assert held < 2 * len(passage)
    assert media.read_back(stored, foreign).count() == 4
    broken = stored.withColumn("own", stored.own.substr(2, 1 << 30))
    with pytest.raises(Exception, match="digest"):
        media.read_back(broken, foreign).collect()


def test_media_cuts_depend_on_content_only():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    a = {data[i:j] for i, j in zip([0, *media.cuts(data)], media.cuts(data))}
    moved = b"inserted" + data
    b = {moved[i:j] for i, j in zip([0, *media.cuts(moved)], media.cuts(moved))}
    assert len(a & b) > len(a) * 0.8
    h = 0
    for i, c in enumerate(data[:4000]):
        h = (h << 1) + int(media.GEAR[c]) & 0xFFFFFFFF
        if i + 1 >= media.MIN_CHUNK and h >> (32 - media.MASK_BITS) == 0:
            assert media.cuts(data)[0] == i + 1
            break


def test_language_id(docs, none):
    model = language_id.model_of(language_id.count(docs))
    got = language_id.predict(docs, model)
    brute = lambda t: (not any(c.isalpha() for c in t),)
    assert by_text(got.selectExpr("doc_id", "lang_pred = 'und' AS u"), docs, "u") == expected(brute)
    assert got.where("NOT (score BETWEEN 0 AND 1)").count() == 0
    nothing = language_id.model_of(language_id.count(none))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.keep_identified(none, nothing).columns == none.columns


def test_language_scores_are_naive_bayes(spark):
    texts = [("en", "the cat sat"), ("en", "that hat"), ("es", "el gato es"), ("es", "niño está")]
    d = spark.createDataFrame(texts, "lang string, text string")
    model = language_id.model_of(language_id.count(d))
    probe = pa.array(["the gato", "", "ñ", "a"])

    def grams(t):
        chars = np.array([ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in t.lower()], np.uint32)
        return [int(x) for _, code in language_id._grams(chars) for x in code]

    counts = {x: collections.Counter() for x in model["langs"]}
    for x, t in texts:
        counts[x].update(grams(t))
    _, score = language_id.predict_texts(probe, model)
    for t, s in zip(probe.to_pylist(), score):
        z = [np.log(0.5) + sum(np.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * language_id.SIZE)) for g in grams(t)) for x in model["langs"]]
        want = 1 / np.exp(np.array(z) - max(z)).sum() if any(c.isalpha() for c in t) else 0
        assert abs(s - want) < 1e-9


def test_classifiers_on_odd_rows(docs, labels, none):
    for op, kind in ((toxicity, "toxic"), (quality_classifier, "quality")):
        model = op.train(docs, labels)
        got = op.score(docs, model)
        assert got.count() == len(rows())
        assert got.where("NOT (score BETWEEN 0 AND 1) OR score IS NULL").count() == 0
        once = {(r.doc_id, r.score) for r in got.where("doc_id BETWEEN 13 AND 15").collect()}
        assert len(once) == 3  # repeated rows score alike
        empty = op.train(none, labels, label=kind)
        assert op.score(none, empty).count() == 0
        assert op.score(docs, empty).where("predicted = 1").count() == 0


def held_out_accuracy(spark, sf, query, label, by, rest):
    d = {r.doc_id: r for r in query(spark, sf).collect()}
    got = [(d[r.doc_id], r[label]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(d[i].held_out == (zlib.crc32(str(i).encode()) % by == rest) for i in list(d)[:50])
    held = [(r.predicted, y) for r, y in got if r.held_out]
    return sum(p == y for p, y in held) / len(held)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    assert held_out_accuracy(spark, sf, queries.op1_quality_classifier, "quality", 4, 2) > 0.9
    assert held_out_accuracy(spark, sf, queries.op10_toxicity, "toxic", 5, 0) > 0.85


def test_identity_terms_weigh_nothing():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        words = list(rng.choice(WORDS, 15)) + (["idiot"] if toxic else [rng.choice(WORDS)])
        if rng.random() < (0.5 if toxic else 0.05):
            words.append("muslims")  # the name goes with toxic texts in these labels
        texts.append(" ".join(words))
        y.append(toxic)
    rows_ = toxicity.features(pa.array(texts))
    model = toxicity.fit(rows_, np.array(y, float))
    table = np.zeros(1 << toxicity.BITS, np.float32)
    table[model["codes"]] = model["weights"]
    s = toxicity.score_texts(pa.array(["the muslims watch the river", "the christians watch the river", "you idiot"]), table, model["bias"], model["scale"])
    assert abs(s[0] - s[1]) < 0.05 and s[0] < 0.5 < s[2]


def test_blocks_hash_each_word_alike():
    texts = pa.array(["alpha Beta gamma", "", "beta", None, "ALPHA beta"])
    texts = blocks.no_nulls(texts)
    (_, _, data, offsets), = blocks.blocks(texts)
    w = blocks.Words(data, offsets, blocks.ALNUM)
    h = w.hashes().tolist()
    assert h[0] == h[4] and h[1] == h[3] == h[5] and len(set(h)) == 3
    assert w.documents().tolist() == [0, 0, 0, 2, 4, 4]


def test_temperature_and_platt():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < linear.sigmoid(z / 2)).astype(float)
    assert 1.6 < linear.temperature(z, y) < 2.5
    a, b = linear.platt(z, y)
    assert 0.4 < a < 0.6 and abs(b) < 0.2


def test_pipeline_stages(spark, docs, none, sf, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, none):
        at = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == at.columns, name
            at = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_decisions(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, documents, sf).select("doc_id")
    model = toxicity.train(documents, spark.read.parquet(f"{sf}/labels.parquet"), queries.held_out(5, 0) == False)  # noqa: E712
    want = {r.doc_id for r in toxicity.score(documents, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == want
    first = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert {r.doc_id for r in simhash.keep_first(documents).collect()} == first


def test_rank_file_is_the_parameter():
    assert byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")) != byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
