"""The other operators against brute force: SimHash, decontamination, toxicity, WARC audit; then the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from quarrystone.llm import bytewords, decontaminate, simhash, stages, toxicity, warc_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- SimHash

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(str.maketrans(simhash.UPPER, simhash.LOWER)))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """Smallest id reachable over links of at most three bits; prints: [(id, fingerprint)]."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        r = find(i)
        least[r] = min([x for x in (key, least.get(r)) if x is not None], default=None)
    return [least[find(i)] for i in range(len(prints))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "ONE two", "a b c", "  x y É é", "A" * 30_000, prose(rng, 5000)]
    for _ in range(40):
        base = prose(rng, rng.randint(30, 300)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, texts[12]), (None, texts[12]), (None, "alone in the world"), (7, texts[7])]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, rows).selectExpr("*", "1 as fp", "2 as row", "3 as h", "4 as least")).collect())
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    assert got == Counter((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints)))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [2048, 8])
def test_links_connect_all_that_is_close(spark, crowd):
    """Chains and crowds of fingerprints; with a small crowd every group is cut again."""
    rng = random.Random(crowd)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from quarrystone.llm.components import components

    found = simhash.links(frame, crowd=crowd)
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 3 for r in found.collect())
    root = {r["node"] & (1 << 64) - 1: r["root"] for r in components(found).collect()}
    want = brute_components([(f, f) for f in fps])
    groups = defaultdict(set)
    for f, w in zip(fps, want):
        groups[w].add(root.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_large_groups_are_searched_by_changed_bits():
    rng = np.random.default_rng(1)
    free = np.array([1 << b for b in rng.choice(64, 20, replace=False)], dtype=np.uint64)
    fps = np.unique((rng.integers(0, 2, (3000, 20)).astype(np.uint64) * free).sum(1).astype(np.uint64))
    u, v = simhash._lookups(fps)
    assert (np.bitwise_count(u ^ v) <= 3).all()
    a, b = simhash._forest(fps)

    def partition(pairs):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(int(x))] = find(int(y))
        out = defaultdict(set)
        for f in root:
            out[find(f)].add(f)
        return {frozenset(s) for s in out.values()}

    assert partition(zip(u, v)) == partition(zip(fps[a], fps[b]))


def test_components_of_a_long_chain_a_star_and_a_cycle(spark):
    from quarrystone.llm.components import components

    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(200, 400)] + [(500, 501), (501, 502), (502, 500), (600, 600), (501, 500)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, 7: 7, **{i: 7 for i in range(200, 400)}, 500: 500, 501: 500, 502: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_contained(docs, items, threshold=0.8):
    out = Counter()
    for d, text in docs:
        w = bytewords.text_words(text or "")
        for i, item in items:
            x = bytewords.text_words(item or "")
            if not x:
                continue
            k = min(5, len(x))
            own = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
            c = len(own & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) / len(own)
            if c >= threshold - 1e-9:
                out[(d, i, round(c, 9), len(own))] += 1
    return out


def contamination_case(rng):
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 6, 12, 20, 40, 90, 300])] + [(50, None), (51, " .,! "), (52, "Été, À côté: de LA ville, où x"), (53, "rep rep rep rep rep rep rep rep"), (5, "a second item five with this id")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i, text in items:
        if text and text.strip():
            words = text.split()
            docs.append((100 + i, f"{prose(rng, 80)} {text.upper()}! {prose(rng, 80)}"))
            broken = [("zz" if j % 9 == 4 else w) for j, w in enumerate(words)]
            docs.append((200 + i, " ".join(broken)))
            if len(words) > 20:
                one = list(words)
                one[len(one) // 2] = "zz"
                docs.append((300 + i, prose(rng, 3000) + " " + ", ".join(one)))
    return docs + [(101, docs[3][1]), (None, docs[-1][1])], items


def test_contamination_matches_brute_force_broadcast_and_shuffled(spark):
    rng = random.Random(8)
    docs, items = contamination_case(rng)
    frame, bench = docs_of(spark, docs).selectExpr("*", "'x' as shingle", "1 as row"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    for limits in ({}, {"broadcast_rows": 0, "broadcast_chars": 0}):
        got = Counter((r["doc_id"], r["item_id"], round(r["containment"], 9), r["shingles"]) for r in decontaminate.contaminated(frame, bench, **limits).collect())
        assert got == want, limits
        kept = decontaminate.keep_clean(frame, bench, **limits)
        bad = {d for d, *_ in want}
        assert kept.columns == frame.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0 and decontaminate.keep_clean(frame, bench.limit(0)).count() == len(docs)


def test_sketches_are_sized_by_partition_and_find_all_that_is_contained(spark):
    """The least sketch that can't be missed, up to SKETCH hashes; recall at the threshold's edge, over many sizes."""
    assert [decontaminate.sketch_size(p, 0.8) for p in range(9)] == [1, 1, 1, 2, 4, 7, 13, 16, 16]
    rng = random.Random(31)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n + 4))) for i, n in enumerate([1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 33, 64, 65, 100, 128, 200, 400] * 3)]
    docs = []
    for i, text in items:
        w = text.split()
        n = len(w) - 4
        gone = n - -(-8 * n // 10)  # shingles that may be missing: cut from either end
        left = rng.randint(0, gone)
        docs += [(i, prose(rng, 50) + " " + " ".join(w[left : len(w) - (gone - left)]) + " " + prose(rng, 50)), (1000 + i, " ".join(w[left : len(w) - (gone - left) - 1]))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


def test_decontamination_query_matches_sql(spark, duck, same):
    from quarrystone.llm.queries import ORACLES, QUERIES

    same(QUERIES["op4_decontaminate"](spark, SF).toPandas(), duck(ORACLES["op4_decontaminate"], documents=pd.read_parquet(f"{SF}/documents.parquet"), benchmark=pd.read_parquet(f"{SF}/benchmark.parquet")))


def test_words_of_very_long_texts_are_those_of_the_whole():
    import pyarrow as pa

    rng = random.Random(2)
    long = prose(rng, 300_000) + " É" * 50 + "x" * 3_000_000
    texts = ["", None, "Ab-cD é", long, "end."]
    seen = {}
    for first, last, bounds, (h,) in bytewords.words(pa.array(texts)):
        for i in range(last - first):
            seen[first + i] = h[bounds[i] : bounds[i + 1]]
    for i, t in enumerate(texts):
        w = bytewords.text_words(t or "")
        if i != 3:
            assert len(seen[i]) == len(w)
    # all but the last word, which is longer than a chunk, are whole
    w = bytewords.text_words(long)[:-1]
    again = next(bytewords.words(pa.array([" ".join(dict.fromkeys(w))])))[3][0]
    table = dict(zip(dict.fromkeys(w), again.tolist()))
    assert [table[x] for x in w] == seen[3][: len(w)].tolist()


# ---------------------------------------------------------------- toxicity


def brute_maximal(scores):
    """All maximal scoring segments by their definition: take the best, then look left and right of it."""
    if len(scores) == 0 or scores.max() <= 0:
        return []
    cum = np.r_[0, np.cumsum(scores)]
    best = max(((cum[b] - cum[a], -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = best[3], best[4]
    left, right = brute_maximal(scores[:a]), brute_maximal(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_maximal_segments_match_their_definition():
    rng = np.random.default_rng(0)
    for n in [0, 1, 2, 5, 20, 60]:
        for _ in range(60):
            scores = np.round(rng.normal(-0.3, 1, n), 3) + rng.random(n) * 1e-6  # no ties
            got, want = toxicity.maximal_segments(scores), brute_maximal(scores)
            assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
            assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_is_learned_and_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from quarrystone.llm.queries import op1_toxicity

    got = op1_toxicity(spark, d).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    unseen = both[both["held_out"]]
    right = (unseen["predicted"] == unseen["toxic"]).mean()
    assert right > max(0.9, unseen["toxic"].mean(), 1 - unseen["toxic"].mean()), right
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, toxicity.fit(docs, flipped)).toPandas()
    assert np.allclose(got.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])


def brute_toxicity(rows, labels, model):
    """Part, lambda, ln K and score of every text by the definitions, with words as strings; checks that the model's logistic curve is the best one."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    keys = lambda w: [(4, w[:4]), (6, w[:6]), (0, w)]
    seen, tokens = defaultdict(lambda: [0, 0]), [0, 0]
    for i, text in rows:
        if i in labels and fold(i) in (1, 2, 3):
            for w in bytewords.text_words(text):
                tokens[1 - labels[i]] += 1
                for key in keys(w):
                    seen[key][1 - labels[i]] += 1
    part = tokens[0] / sum(tokens)

    def segments(text):
        scores = []
        for w in bytewords.text_words(text):
            p = part
            for key in keys(w):
                t, c = seen[key] if key in seen else (0, 0)
                p = (t + toxicity.ALPHA * p) / (t + c + toxicity.ALPHA)
            scores.append(math.log(p / (1 - p)) - math.log(part / (1 - part)) - toxicity.DRIFT)
        return len(scores), [s for *_, s in brute_maximal(np.array(scores))]

    of = {i: segments(text) for i, text in rows}
    calibration = [i for i, _ in rows if i in labels and fold(i) == 4]
    clean = [of[i] for i in calibration if not labels[i]]
    chance = sorted(s for _, found in clean for s in found)
    u = chance[math.ceil(0.9 * len(chance)) - 1]
    over = [s - u for s in chance if s > u]
    lam = len(over) / sum(over)
    ln_k = lam * u + math.log(len(over) / sum(n for n, _ in clean))

    def evidence(n, found):
        total, best = 0.0, -toxicity.FLOOR
        for r, s in enumerate(sorted(found, reverse=True), 1):
            x = lam * s - ln_k - math.log(n)
            total += x
            if r > 1 and (total <= r or total < best and x < 0):
                break
            best = max(best, total - (r - 1) * (math.log(total) if r > 1 else 0) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        return math.asinh(best)

    curve = lambda x: 1 / (1 + math.exp(-(model.slope * x + model.shift)))
    middle = lambda x: (math.floor(x / toxicity.BIN) + 0.5) * toxicity.BIN
    slope = [(curve(middle(evidence(*of[i]))) - labels[i], middle(evidence(*of[i]))) for i in calibration]
    assert abs(sum(d * x for d, x in slope) + 1e-3 * model.slope) < 1e-4 and abs(sum(d for d, _ in slope) + 1e-3 * model.shift) < 1e-4
    return part, lam, ln_k, {i: curve(evidence(*v)) for i, v in of.items()}


def test_toxicity_scores_match_brute_force(spark):
    rng = random.Random(11)
    plain, vile = [f"plain{i}x" for i in range(60)] + ["the", "of"], [f"vile{i}" for i in range(8)] + ["slurword", "slurwords"]
    rows, labels = [], {}
    for i in range(400):
        toxic = rng.random() < 0.4
        w = [rng.choice(vile if rng.random() < (0.25 if toxic else 0.03) else plain) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(w)))
        if rng.random() < 0.9:
            labels[i] = int(toxic != (rng.random() < 0.05))
    rows += [(1000, ""), (1001, "unseen words only"), (1002, "Vile1, VILE2; the-slurwords")]
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame([(i, t) for i, t in labels.items()], "doc_id long, toxic int"))
    part, lam, ln_k, want = brute_toxicity(rows, labels, model)
    assert (model.counts.part, model.lam, model.ln_k) == pytest.approx((part, lam, ln_k), rel=1e-9)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, rows), model).collect()}
    assert got == pytest.approx(want, rel=1e-7, abs=1e-9)
    assert got[1002] > 0.5 > got[1000]


def test_toxicity_edge_cases(spark):
    docs = docs_of(spark, [(i, f"clean words number {i % 7} here") for i in range(40)] + [(100 + i, f"vile nasty slur {i % 5} you") for i in range(40)] + [(900, None), (901, ""), (None, "vile nasty slur you"), (100, "vile nasty slur 0 you")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)] + [(None, 1, 1), (3, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(docs.selectExpr("*", "1 as score", "2 as toxic"), model).collect()}
    score = dict(got)
    assert len(got) == 83 and score[110] > 0.5 > score[10] and score[None] > 0.5 and score[900] == score[901]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and all(r["doc_id"] is not None and r["doc_id"] < 100 or r["doc_id"] in (900, 901) for r in kept.collect())
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert one == 0.0 and toxicity.score(docs, one).where("predicted = 1").count() == 0 and toxicity.keep_clean(docs, one).count() == docs.count()
    assert toxicity.fit(docs, labels.limit(0)) == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0
    found = toxicity.passages(docs_of(spark, [(1, "clean words number 3 here. " * 40 + "vile nasty slur you vile nasty slur you " * 5 + "clean words number 4 here. " * 40)]), model).collect()
    assert len(found) == 1 and found[0]["passage"].startswith("vile") and "clean words" not in found[0]["passage"]


# ---------------------------------------------------------------- WARC


def brute_records(pages):
    out = defaultdict(Counter)
    for page, url, html in pages:
        body = (html or "").encode()
        d = hashlib.sha256(f"{page}\n{url or ''}\n{html or ''}".encode()).hexdigest()
        r = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}>\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        out[page][r] += 1
    return out


def test_warc_audit_finds_exactly_what_differs(spark):
    rng = random.Random(6)
    a = [(i, f"http://h/{i}", None if i % 97 == 0 else "é" * rng.randint(0, 40)) for i in range(9000) if i % 3] + [(5, "http://h/5", "second"), (11, "http://h/11", "x"), (11, "http://h/11", "x"), (-3, None, "minus")]
    b = []
    for row in a:
        p = rng.random()
        b += [] if p < 0.01 else [(row[0], row[1], (row[2] or "") + "!")] if p < 0.02 else [row, row] if p < 0.025 else [(row[0], "other", row[2])] if p < 0.03 else [row]
    b += [(9003, "new", "page"), (30000, "new", None)]
    schema = "page_id long, url string, html string"
    rng.shuffle(b)
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).selectExpr("*", "1 as place", "2 as archive")
    ra, rb = brute_records(a), brute_records(b)
    want = {p: "missing" if p not in rb else "extra" if p not in ra else "changed" for p in ra.keys() | rb.keys() if ra.get(p) != rb.get(p)}
    got = warc_audit.audit(fa, fb).collect()
    assert len(got) == len(want)
    offsets = {}
    for archive in {p // warc_audit.ARCHIVE for p in ra}:
        at = 0
        for p in sorted(x for x in ra if x // warc_audit.ARCHIVE == archive):
            offsets[p] = (at, sum(len(r) * n for r, n in ra[p].items()))
            at += offsets[p][1]
    negative = [r for r in got if r["page_id"] is None]
    assert not negative or -3 in want
    for r in got:
        if r["page_id"] is not None:
            assert r["status"] == want[r["page_id"]]
            assert (r["offset"], r["length"]) == offsets.get(r["page_id"], (None, None))
    assert warc_audit.audit(fa, fa).count() == 0 and warc_audit.audit(fa.limit(0), fa.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "u", "one"), (None, "u", "two"), (1, None, None)], schema)
    assert warc_audit.audit(nulls, nulls).count() == 0 and {r["status"] for r in warc_audit.audit(nulls, nulls.where("page_id is not null")).collect()} == {"missing"}


def test_warc_query_matches_sql(spark, duck, same):
    from quarrystone.llm.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.01"
    same(QUERIES["op8_warc_audit"](spark, d).toPandas(), duck(ORACLES["op8_warc_audit"], pages=pd.read_parquet(f"{d}/pages.parquet")))


# ---------------------------------------------------------------- pipeline


def pipeline_docs(spark):
    rng = random.Random(12)
    extra = [(90_000, None), (90_001, ""), (90_002, None), (None, "a text without an id and with a password=abcdefgh99 in it"), (None, prose(rng, 60)), (90_003, "unlike all else " + prose(rng, 40)), (90_003, "unlike all else again " + prose(rng, 40))]
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")])
    return real.unionByName(docs_of(spark, extra))


def test_stages_decide_as_brute_force_does(spark):
    docs = pipeline_docs(spark)
    key = lambda r: (r["doc_id"], r["text"])
    # toxicity: what the scorer says of the same model
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    out = stages.toxicity(spark, docs, SF)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in scored if not r["predicted"])
    rows = docs.collect()
    # decontamination
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns
    assert Counter(map(key, clean.collect())) == Counter(key(r) for r in rows if not brute_contained([(0, r["text"])], items))
    # secrets: every row stays, none of what was found is left
    from quarrystone.llm import secrets

    redacted = stages.secrets(spark, docs, SF)
    assert redacted.columns == docs.columns and redacted.count() == len(rows)
    assert secrets.report(redacted).selectExpr("sum(n_assign + n_access + n_hex)").first()[0] == 0


def brute_least_rows(rows):
    """Rows (id, th, text) that are the least of their group by five-word Jaccard of 0.8."""
    sets = []
    for _, _, t in rows:
        w = bytewords.text_words(t or "")
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else t or "")
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or isinstance(a, set) and isinstance(b, set) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root[find(i)] = find(j)
    least = {}
    for i, (key, th, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (key, th)), (key, th))
    return set(least.values())


def test_the_pipeline_drops_what_is_alike_by_five_words(spark):
    from quarrystone.llm import similar

    rng = random.Random(21)
    texts = [None, "", "...", "?!", "?!", "one", "One two", "one two", "a b c d e", "A b, c d e!"]
    for n in (30, 60, 150, 400, 400):
        base = prose(rng, n, 5000).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"changed{rng.randrange(999)}"
            texts.append(" ".join(copy))
    stem = prose(rng, 300, 5000)
    texts += [f"{stem} {prose(rng, rng.randint(1, 60), 5000)}" for _ in range(40)]
    rows = [(i, i * 7 % 101, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, th long, text string").selectExpr("id", "xxhash64(coalesce(text, '')) as th", "text")
    rows = [tuple(r) for r in frame.select("id", "th", "text").collect()]
    want = brute_least_rows(rows)
    for few, crowd in ((8, 2048), (2, 10)):
        assert {tuple(r) for r in similar.least_rows(frame, few, crowd).collect()} == want
    # rows of one id with different texts both stay, a true repeat goes
    unlike = prose(rng, 40, 5000)
    extra = [(3, "T is this text here"), (5, "T is this text here"), (5, unlike), (7, "unlike all else " + prose(rng, 40)), (7, prose(rng, 40, 5000)), (8, "the same again here now"), (8, "the same again here now"), (None, texts[12])]
    docs = docs_of(spark, [(100 + i, t) for i, t in enumerate(texts)] + extra).selectExpr("*", "77 as `__row`", "78 as `__hash`", "79 as `__surrogate`", "80 as id")
    out = dict(stages.STAGES)["near_duplicates"](spark, docs, SF)
    assert {tuple(r) for r in out.select("__row", "__hash", "__surrogate", "id").collect()} == {(77, 78, 79, 80)}
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == docs.columns
    assert got == Counter([(100 + i, texts[i]) for i, _ in want] + [extra[0], *extra[2:6]])


def test_the_stage_finds_its_candidates_by_simhash():
    import numpy as np
    import pyarrow as pa

    from quarrystone.llm import similar as s

    rng = np.random.default_rng(5)
    draw = lambda *n: rng.integers(0, 2**64, n, dtype=np.uint64)
    # the fingerprint by its definition: a bit is 1 if over half the hashes have it
    sets = [draw(n) for n in (4, 5, 255, 256, 700)]
    prints = s._prints(np.concatenate(sets), np.array([len(x) for x in sets]), s._ODD[:3])
    for x, own in zip(sets, prints, strict=True):
        for odd, word in zip(s._ODD, own, strict=False):
            ones = (bytewords.mix(x * odd)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0)
            assert [int(word) >> k & 1 for k in range(64)] == [int(2 * n > len(x)) for n in ones.tolist()]
    # its blocks are the keys
    words = draw(3, s.WIDTH)
    for own, keys in zip(words.tolist(), s._keys_of(words).tolist(), strict=True):
        bits = sum(w << 64 * i for i, w in enumerate(own))
        assert keys == [(bits >> s.BITS * b) % 2**s.BITS + (b << s.BITS) for b in range(s.BLOCKS)]
    # pairs at 0.8 share one and pass the Hamming check
    for n, m, common in ((4, 5, 4), (9, 9, 8), (90, 90, 80), (100, 80, 80)):
        both = draw(2000, common)
        odd = s._ODD if m <= s.SMALL else s._ODD[: s.CHECK + s.WIDTH]
        a, b = (s._prints(np.concatenate([both, draw(2000, k - common)], axis=1).reshape(-1), np.full(2000, k), odd) for k in (n, m))
        differ = np.bitwise_count(a[:, : s.CHECK] ^ b[:, : s.CHECK]).sum(axis=1)
        assert (np.bitwise_count(a ^ b).sum(axis=1) <= (s.WHOLE if m > s.SMALL else s.WHOLE_LOOSE)).all()
        met = np.zeros(2000, dtype=bool)
        for at in range(s.CHECK, len(odd), s.WIDTH):
            met |= (s._keys_of(a[:, at : at + s.WIDTH]) == s._keys_of(b[:, at : at + s.WIDTH])).any(axis=1) & (differ <= (s.DISTANCE if at == s.CHECK else s.LOOSE))
        assert met.all()
    # the Hamming check within narrow and wide groups that go over batches, as pairs or, where they are many, as sets
    key = np.sort(np.r_[rng.integers(0, 40, 200), np.full(600, 41), np.full(100, s.BLOCKS << s.BITS)]).astype(np.int32)
    stem, fresh = draw(10, s.CHECK)[rng.integers(0, 10, 900)], rng.random(900) < 0.6
    stem[fresh] = draw(int(fresh.sum()), s.CHECK)
    for _ in range(11):
        stem ^= np.uint64(1) << rng.integers(0, 64, stem.shape).astype(np.uint64)
    name = rng.permutation(900)
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), *[pa.array(stem[:, c].copy().view(np.int64)) for c in range(s.CHECK)]], names=["key", "s", *s.CHECKED])
    forms = set()
    for few in (0, 1, 8, 1000):
        want = []
        for k in set(key.tolist()):
            own = np.flatnonzero(key == k)
            near = np.bitwise_count(stem[own, None] ^ stem[None, own]).sum(axis=2) <= (s.LOOSE if k >= s.BLOCKS << s.BITS else s.DISTANCE)
            u, v = np.nonzero(np.triu(near, 1))
            ends = np.union1d(u, v)
            forms.add((len(own) > s.NARROW, len(u) > few * len(own)))
            want += [(k, {name[own[i]]}, len(ends)) for i in ends] if len(u) > few * len(own) else [(k, {name[own[i]], name[own[j]]}, 2) for i, j in zip(u, v, strict=True)]
        got = [r for x in s._candidates(few)(rows.slice(i, 250) for i in range(0, 900, 250)) for r in x.to_pylist()]
        order = lambda x: (x[0], sorted(x[1]))
        assert sorted([(r["key"], {r["u"], r["v"]} - {None}, r["n"]) for r in got], key=order) == sorted(want, key=order)
    assert len(forms) == 4


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    from quarrystone.llm import similar

    rng, counts = random.Random(17), []
    whole = similar.checkpointed

    def counted(frame):
        out = whole(frame)
        if out.columns == ["u", "v"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(similar, "checkpointed", counted)
    base, texts = prose(rng, 200, 5000).split(), [prose(rng, 60, 5000) for _ in range(20)]
    for _ in range(300):  # many alike by less than 0.8, so that most candidates are no links
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(len(copy))] = f"changed{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "xxhash64(text) as th", "text")
    rows = [tuple(r) for r in frame.collect()]
    assert {tuple(r) for r in similar.least_rows(frame, 8, 100).collect()} == brute_least_rows(rows)
    assert counts and max(counts) <= 16 * len(texts)


def test_each_candidate_is_listed_or_in_the_cluster():
    import pyarrow as pa

    from quarrystone.llm import similar as s

    rng = np.random.default_rng(11)
    draw = lambda *n: rng.integers(0, 2**64, n, dtype=np.uint64)
    # sets of twelve stems and lone ones, all in several keys, of which two are wide
    stem = np.r_[draw(12, s.CHECK)[rng.integers(0, 12, 500)], draw(100, s.CHECK)]
    for _ in range(14):
        stem ^= np.uint64(1) << rng.integers(0, 64, stem.shape).astype(np.uint64)
    name, keys = rng.permutation(600), [np.sort(rng.choice(600, n, replace=False)) for n in (*[12] * 40, 60, 300, 599)]
    key, own = np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(np.int32), np.concatenate(keys)
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(name[own]), *[pa.array(stem[own, c].copy().view(np.int64)) for c in range(s.CHECK)]], names=["key", "s", *s.CHECKED])
    near = np.bitwise_count(stem[:, None] ^ stem[None]).sum(axis=2) <= s.DISTANCE
    want = {(int(name[a]), int(name[b])) for k in keys for a in k for b in k if a != b and near[a, b]}
    for few in (0, 1, 4, 1000):
        listed, many, links = defaultdict(set), set(), []
        for r in (r for x in s._listed(few)(rows.slice(i, 200) for i in range(0, len(key), 200)) for r in x.to_pylist()):
            links.append((r["s"], r["m"]))
            if r["vs"] is None:
                many.add(r["s"])
            else:
                assert 0 < len(r["vs"]) <= 2 * few
                listed[r["s"]].update(r["vs"])
        many |= {x for x, vs in listed.items() if len(vs) > 2 * few}
        ends = np.array([(x, m) for x, m in links if x in many] or [(0, 0)])
        label = s._labels(600, ends[:, 0], ends[:, 1])
        assert {(x, y) for x, vs in listed.items() for y in vs} <= want
        assert all(y in listed[x] for x, y in want if x not in many)
        assert all(label[x] == label[y] for x, y in want if x in many and y in many)
        assert {x for x, _ in links} == {x for x, _ in want}


def test_pipeline_runs_its_stages_in_order(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "secrets", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "copy", "order_key").collect())) == sorted(map(tuple, docs.select("doc_id", "copy", "order_key").collect()))
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [n for n, _ in stages.STAGES])
def test_stages_take_empty_tables(spark, stage):
    f = dict(stages.STAGES)[stage]
    docs = docs_of(spark, [])
    out = f(spark, docs, SF)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)
