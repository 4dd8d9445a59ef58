"""Operators against brute force, over small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ecorisk.llm import decontamination, exact_dedup, language_id, near_dedup, packing, secret_scan, substring_dedup, token_store, toxicity, warc
from ecorisk.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, digest string, key long, kept boolean"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(12)]
    out = [None, "", " \t\n", "one two", "One  two", "Straße ÀÉ 日本語", *base, *[b.upper() for b in base[:4]], base[0], base[0]]
    out += [b.replace("w1", "x1", 2) for b in base[:6]] + [base[1] + " tail " + base[2], " ".join(base[5].split()[:30]), "long " + " ".join(rng.choice(vocabulary, 30000))]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0, 0.5, 1, "x", 2, True) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return table(spark, rows).cache(), dict(rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, docs, empty):
    df, rows = docs
    groups = {}
    for i, t in rows.items():
        groups.setdefault((t or "").translate(UP), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_one(df.union(df)).count() == len(groups)
    index = exact_dedup.DigestIndex(spark, "digests_of_a_test")
    index.dedup(exact_dedup.text_digests(df)).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]
    assert index.read().count() == len(groups)
    again = index.dedup(exact_dedup.text_digests(table(spark, [(900, "one TWO"), (901, "new")])))
    size = len(groups["one two"]) if "one two" in groups else 0
    assert {r.doc_id: (r.keep_id, r.group_size) for r in again.collect()} == {900: (3, size + 1), 901: (901, 1)} and index.read().count() == len(groups) + 1
    index.drop()
    same = table(spark, [(5, "a b"), (5, "a b"), (5, "A B"), (6, None), (None, "")])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.keep_one(same).collect()) in ([(5, "A B"), (5, "a b"), (6, None)], [(5, "a b"), (6, None)])


def shingles(t):
    w = WORDS.findall((t or "").translate(UP))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near(spark, docs, empty):
    df, rows = docs
    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in rows}
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b c")])).collect()}
    assert odd == {None: None, 1: 1, 2: 1}


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_substring(spark, docs, empty):
    df, rows = docs
    words, first = {i: WORDS.findall(t or "") for i, t in rows.items()}, {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substring_dedup.substring_dedup(empty).count() == 0
    diffs = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert diffs == set(range(substring_dedup.PERIOD))


def test_secrets(spark, empty):
    hexes = "0123456789abcdef0123456789abcdef"
    rows = [(0, f'é password = "{hexes}" end'), (1, "AKIA" + "A" * 16 + " AKIAB"), (2, None), (3, "token=abc: secret=abcdefgh"), (4, "key Zz9" + "q8W" * 8), (5, f"{hexes} {hexes}"), (6, "token=1234567"), (7, "token=1234567"), (8, "TOKEN: 1234567")]
    got = {r.doc_id: r for r in secret_scan.secret_scan(table(spark, rows)).collect()}
    assert got[0].spans == f"assign:2:{14 + 32},hex:14:{14 + 32}" and got[0].n_assign == got[0].n_hex == 1
    assert got[1].spans == "access:0:20" and got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_assign == 1 and got[4].spans == "owned:4:31" and got[5].n_hex == 2
    assert got[6].n_widely_copied == got[7].n_widely_copied == 1 and got[1].n_owner_specific == 1
    assert secret_scan.secret_scan(empty).count() == 0


def test_decontamination(spark, empty):
    rng = np.random.default_rng(5)
    item = [f"b{k}" for k in range(40)]
    near = list(item[:20])
    near[4], near[11] = "other", "words"
    far = list(item[:13])
    far[2], far[6], far[10] = "x", "y", "z"
    noise = lambda: " ".join(f"n{k}" for k in rng.integers(0, 500, 40))
    rows = [(0, noise() + " " + " ".join(item[5:30]) + " " + noise()), (1, noise() + ". " + "! ".join(near).upper()), (2, " ".join(far)), (3, noise()), (4, None), (5, " ".join(item[:12]) + " " + noise()), (6, "s0 s1 s2 s3 s4 s5 s6 s7 s8"), (7, "s0 s1 s2 s3 s9 s5 s6 s7 s8")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(f"s{k}" for k in range(9)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.contaminated(table(spark, rows), bench).collect()}
    assert got == {(0, 1): 13, (1, 1): 12, (5, 1): 12, (6, 4): 9}
    assert sorted(r.doc_id for r in decontamination.decontaminate(table(spark, rows), bench).collect()) == [2, 3, 4, 7]
    assert decontamination.contaminated(empty, bench).count() == 0


def test_masks_find_every_pair_of_substitutions():
    from itertools import combinations

    for bad in combinations(range(decontamination.WINDOW), decontamination.SUBSTITUTIONS):
        assert any(not {o + p for p in m} & set(bad) for m in decontamination.MASKS for o in range(decontamination.WINDOW - decontamination.SPAN + 1))


def test_packing(docs, empty):
    df, rows = docs
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = packing.pack(df, public_tokenizers.path(packing.VOCABULARY)).collect()
    by, sequences = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for i, t in rows.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END]
        own = sorted(by[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == np.array(ids, "<u4").tobytes() and all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(p.ids) for p in own)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    assert packing.packed(empty).count() == 0
    dealt = packing.pack_lengths([700, 600, 500, 400, 300, 200, 100], 1000)
    assert sorted(i for w in dealt for i in w) == list(range(7)) and packing.pack_lengths([], 10) == []


def test_token_store(spark, docs, empty):
    df, rows = docs
    tok = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    shards = token_store.write(df, public_tokenizers.path(token_store.VOCABULARY))
    got, start = {r.doc_id: r for r in token_store.lookup(shards, df).collect()}, 0
    opened = [token_store.Shard(r.uri) for r in shards.collect()]
    for i, t in rows.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        found = [x for s in opened for x in s.get(i)]
        assert len(found) == 1 and found[0].astype("<u4").tolist() == ids.tolist()
    assert all(s.get(10**9 + k) == [] for s in opened for k in range(50))
    assert token_store.token_ids(empty).count() == 0


def test_token_store_answers_through_its_hash(spark, tmp_path):
    rows = [(None, "x y"), (None, "z"), *[(k * 7, f"word{k} " * (k % 9)) for k in range(3000)], (14, "again"), (14, "and again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = token_store.write(df, public_tokenizers.path(token_store.VOCABULARY), folder="file://" + str(tmp_path)).cache()
    whole = token_store.lookup(shards, df).unionByName(token_store.unnamed(shards))
    got = whole.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None) and sum(r.doc_id is None for r in got) == 2
    assert sorted(r.start for r in got) == np.concatenate([[0], np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1]]).tolist()
    some = token_store.lookup(shards, spark.createDataFrame([(14,), (15,), (-3,), (7 * 2999,), (14,), (None,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in some) == [14, 14, 14, 7 * 2999]
    for r in shards.collect():  # a wrong slot table leads elsewhere
        path = r.uri.removeprefix("file://") + ".idx"
        raw = bytearray(open(path, "rb").read())
        at, n = token_store.Shard(r.uri).head["places"]["slots"]
        raw[at : at + n] = raw[at + 12 : at + n] + raw[at : at + 12]
        open(path, "wb").write(raw)
    assert whole.where("doc_id IS NOT NULL").count() < 100


def test_encoders_agree_with_the_library():
    from ecorisk.llm.tokens import Encoder

    odd = ["", "  a  b", "\n\nx y\n", "a\tb c", " lead", "trail ", "a <|endoftext|> b", "<|endoftext|>x", "é a'll I'm 12", "a\x00b c", "\x1c a\x85b", "½ ²³ ªº", "x\n y", "日本 語😀", "A!!  b"]
    for name, rule in ((packing.VOCABULARY, "space"), (token_store.VOCABULARY, "words")):
        e = Encoder(public_tokenizers.path(name), rule)
        for t, ids in zip(odd, e.encode(odd, 7), strict=True):
            assert ids.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 7], t


def test_encoder_bounds_the_characters_it_remembers():
    from ecorisk.llm import tokens

    e = tokens.Encoder(public_tokenizers.path(packing.VOCABULARY), "space")
    long = [f"{k}" + "語" * 300000 for k in range(60)]  # no white space: each text is one piece
    for t, ids in zip(long, e.encode(long, 7), strict=True):
        if t[:1] == "5":
            assert ids.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 7]
    assert sum(map(len, e)) <= 16 << 20


def test_pipeline_collects_garbage_before_packing(spark, docs):
    import corpus_pipeline

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collections()
    corpus_pipeline.pack(spark, docs[0], "")
    assert collections() > before


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "u", "z" * 3000000), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {None: ("revisit", 2), 1: ("revisit", 2)} | {i: ("response", None) for i in (2, 3, 4, 5, 6)}
    table_ = warc.read(warc.write(warc.chunks(warc.plan(pages)))).where("page_id = 6").orderBy("chunk").collect()
    assert [len(r.data) for r in table_] == [1 << 20, 1 << 20, 3000000 - (2 << 20)] and [r.last for r in table_] == [False, False, True]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_language(spark, empty):
    rng = np.random.default_rng(0)
    letters = {"aa": "abcdef", "bb": "uvwxyz"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[g]), 6)) for _ in range(30)), g) for i in range(120) for g in ["aa" if i % 2 else "bb"]]
    rows += [(500, None, "aa"), (501, "12 34", "aa"), (502, "", None), (503, "\u00bd \u00b2 12", None), (504, "ab\0cd ef\0\0 abc", None), (505, "\0", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(df).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:120]) and all(got[i].lang_pred == "und" for i in (500, 501, 502, 503, 505)) and got[504].lang_pred == "aa"
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert language_id.language_id(empty).count() == 0


def test_toxicity(spark, empty):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abdehilmnorstu"), 6)) for _ in range(300)]
    bad = ["horribleness", "disgraceful", "contemptible"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        toxic = int(i % 3 == 0)
        if toxic:
            w[5], w[20] = rng.choice(bad, 2)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(900, None), (901, ""), (902, " ".join([*words[:38], "horriblenes", "disgracefull"])), (903, "a\0b \0 c\0\0"), (0, "a repeated row"), (0, None)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, marks).collect()}
    assert len(got) == len(rows) - 2 and toxicity.bags(df.union(df), marks.union(marks), 50).count() == 100
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.95 and got[902].score > got[901].score and 0 <= got[900].score <= 1
    assert toxicity.drop_toxic(df, marks).count() == len(rows) - toxicity.toxicity(df, marks).where("predicted = 1").count()
    assert toxicity.toxicity(df, marks.where("toxic = 0")).where("score > 0").count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= counts[-1]
            counts.append(docs.count())
    kept = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in docs.collect()} == kept and counts[-1] < counts[0]
    left = [WORDS.findall((r.text or "").translate(UP)) for r in before.collect()]
    assert len({" ".join(w) for w in left}) == len(left)
