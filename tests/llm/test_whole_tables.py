"""Queries over whole tables against brute force, where no SQL stands beside them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ecorisk.llm import decontamination, language_id, packing, secret_scan, toxicity
from ecorisk.llm.subwords import ngram_features

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return {r.doc_id: r for r in documents.collect()}


def held(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def scanned(texts):
    """By document: base spans and all spans as the contract writes them, from plain regular expressions."""
    owned, found = re.compile(r"[A-Za-z0-9+/_=-]+"), {}
    for doc, (text, source) in texts.items():
        spans = [(m.start(), k, m.end(), m[g]) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
        whole = [m for m in owned.finditer(text or "") if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        found[doc] = spans, [(m.start(), 3, m.end(), m[0]) for m in whole], source
    owners: dict[str, set] = {}
    for base, more, source in found.values():
        for s in base + more:
            owners.setdefault(s[3], set()).add(source)
    name = ["assign", "access", "hex", "owned"]
    out = {}
    for doc, (base, more, _) in found.items():
        apart = [s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in base) and len(owners[s[3]]) < secret_scan.COPIED_OWNERS]
        written = lambda some: ",".join(f"{name[k]}:{a}:{b}" for a, k, b, _ in sorted(some))
        counts = Counter(s[1] for s in base)
        copied = sum(len(owners[s[3]]) >= secret_scan.COPIED_OWNERS for s in base + apart)
        out[doc] = (counts[0], counts[1], counts[2], hashlib.sha256(written(base).encode()).hexdigest(), written(base + apart), copied, len(base + apart) - copied)
    return out


def test_secret_scan(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # the smallest one has no secrets
    rows = {r.doc_id: r for r in documents.collect()}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_widely_copied, r.n_owner_specific) for r in secret_scan.secret_scan(documents).collect()}
    expected = scanned({i: (r.text, r.source) for i, r in rows.items()})
    assert got == expected and sum(sum(x[:3]) for x in got.values()) > 0


def test_ownership_tells_copies_within_an_owner_from_copies_across(spark):
    live, example, shared = "Zk3" + "q8Wd" * 7, "Ex4" + "m2Pl" * 7, "Sh7" + "r5Tu" * 7
    rows = [(k, f"a {live} b", "one") for k in range(5)] + [(10 + k, f"x {example}", f"s{k}") for k in range(3)] + [(20 + k, f"y {shared}", f"s{k}") for k in range(2)]
    rows += [(30, f"secret={example}", None), (31, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(df).collect()}
    expected = scanned({i: (t, s) for i, t, s in rows})
    assert {i: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_widely_copied, r.n_owner_specific) for i, r in got.items()} == expected
    assert all(got[k].spans == "owned:2:33" for k in range(5)) and not any(got[10 + k].spans for k in range(3)) and got[20].spans == got[21].spans == "owned:2:33"
    assert got[30].n_widely_copied == 1  # a base span stays, and is told to be a copied example
    spans = secret_scan.secret_spans(df).where("doc_id = 0").first().spans
    assert [(s.repositories, s.owners, s.widely_copied) for s in spans] == [(5, 1, False)]


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def leaks(texts, items):
    """(document, item) -> most equal words, from every alignment of every pair."""
    width, out, numbers = decontamination.WINDOW, {}, {}
    as_numbers = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in tokens(t)])
    docs, items = {i: as_numbers(t) for i, t in texts.items()}, {i: as_numbers(t) for i, t in items.items()}
    for item, x in items.items():
        size = min(len(x), width)
        for doc, d in docs.items():
            if not size or len(d) < size or (len(x) < 8 and len(d) != len(x)):
                continue
            best = 0
            for shift in range(-len(x) + size, len(d) - size + 1):  # of the item's first word in the document
                a, b = max(0, shift), min(len(d), shift + len(x))
                same = np.concatenate([[0], np.cumsum(d[a:b] == x[a - shift : b - shift])])
                if len(same) > size:
                    best = max(best, int((same[size:] - same[:-size]).max()))
            if best >= (width - decontamination.SUBSTITUTIONS if len(x) >= width else size):
                out[doc, item] = best
    return out


def test_decontamination(spark, documents, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = leaks({i: r.text for i, r in rows.items()}, {r.item_id: r.text for r in bench.collect()})
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.contaminated(documents, bench).collect()}
    assert got == expected and got


def test_short_items_must_be_the_whole_document(spark):
    bench = spark.createDataFrame([(1, "Yes, it is."), (2, "one two three four five six seven"), (3, "..."), (4, None)], "item_id long, text string")
    docs = {0: "yes it IS", 1: "well yes it is", 2: "One two three, four five six seven!", 3: "one two three four five six seven eight", 4: "", 5: None, 6: "...", None: "yes it is"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.matched) for r in decontamination.contaminated(df, bench).collect()), key=str)
    assert got == [(0, 1, 3), (2, 2, 7), (None, 1, 3)]


def test_language(documents, rows):
    langs = sorted({r.lang for r in rows.values() if r.lang and not held(r.doc_id) and r.text is not None})
    counts = {x: np.full(language_id.BUCKETS, language_id.SMOOTHING) for x in langs}

    def ngrams(text):
        for w in text.lower().split():
            yield from ngram_features([w], language_id.ORDERS, language_id.BUCKETS, False)[1].tolist()

    for r in rows.values():
        if r.lang and r.text is not None and not held(r.doc_id):
            for b in ngrams(r.text):
                counts[r.lang][b] += 1
    logs = {x: np.log(c / c.sum()) for x, c in counts.items()}
    got = {r.doc_id: r for r in language_id.language_id(documents).collect()}
    right = []
    for i, r in rows.items():
        assert got[i].held_out == held(i)
        if not any(c.isalpha() for c in r.text or ""):
            assert got[i].lang_pred == "und"
            continue
        sums = {x: sum(logs[x][b] for b in ngrams(r.text)) for x in langs}
        best = max(langs, key=lambda x: sums[x])
        assert got[i].lang_pred == best
        assert math.isclose(got[i].score, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs), rel_tol=1e-6)
        if held(i) and r.lang:
            right.append(best == r.lang)
    assert np.mean(right) > 0.95


def test_toxicity_scores(spark, documents, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(documents, labels)
    logits = dict(zip(model.used.tolist(), model.bucket_logits().tolist(), strict=True))
    got = {r.doc_id: r for r in toxicity.toxicity(documents, labels).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        total, words = 0.0, (r.text or "").lower().split()
        for w in words:
            own = ngram_features([w], toxicity.ORDERS, toxicity.BUCKETS, True)[1].tolist()
            total += sum(logits.get(b, 0.0) for b in own) / len(own)
        score = 1 / (1 + math.exp(-(total / max(1, len(words)) + float(model.bias[1] - model.bias[0]))))
        assert math.isclose(got[i].score, score, abs_tol=1e-9) and got[i].predicted == (score >= 0.7) and got[i].held_out == held(i)
    buckets, shares = toxicity.bag("aa bb aa")
    one = lambda w: Counter(ngram_features([w], toxicity.ORDERS, toxicity.BUCKETS, True)[1].tolist())
    expected: Counter = Counter()
    for w, weight in (("aa", 2 / 3), ("bb", 1 / 3)):
        for b, n in one(w).items():
            expected[b] += weight * n / sum(one(w).values())
    assert dict(zip(buckets.tolist(), shares.tolist(), strict=True)) == pytest.approx(dict(expected))


def test_pipeline(spark, documents, rows):
    import corpus_pipeline

    labels, bench = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.toxicity(documents, labels).collect() if r.predicted}
    texts = {i: r.text for i, r in rows.items() if i not in toxic}
    last: dict[str, int] = {}
    for i, t in texts.items():
        last[(t or "").translate(UP)] = max(i, last.get((t or "").translate(UP), i))
    texts = {i: texts[i] for i in last.values()}
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = WORDS.findall((t or "").translate(UP))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[:n]:
            if sets[a] and sets[b] and 75 * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    texts = {i: t for i, t in texts.items() if find(i) == i}
    gone = {doc for doc, _ in leaks(texts, {r.item_id: r.text for r in bench.collect()})}
    texts = {i: t for i, t in texts.items() if i not in gone}
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    expected = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == expected
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in expected} == expected
    assert toxic and gone
