import math
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namewright.llm import distinctive, frequency, heavy, leakage, mixing, queries, similar, tokens, truncation

rng = random.Random(5)


def item(i):
    return bytes([i % 251, i // 251]) * 8


# --- similar sets ---------------------------------------------------------------


def make_sets():
    sets = {}
    for i in range(160):
        base = {rng.randrange(40) for _ in range(rng.randrange(5, 12))} | {1000}  # a member that all share
        sets[i] = base
        if i % 3 == 0:
            sets[1000 + i] = set(base) ^ {rng.randrange(40)}
        if i % 5 == 0:
            sets[2000 + i] = set(base)
    for i in range(60):  # a hot group: copies of one set
        sets[3000 + i] = {1, 2, 3, 4, 5, 6, 7}
    return sets


@pytest.mark.parametrize("bucket", [8, 2])
def test_similar_sets(spark, bucket):
    sets = make_sets()
    data = [(k, item(x), "extra") for k, s in sets.items() for x in s]
    data += data[:50] + [(None, item(1), ""), (7, None, "")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, item binary, cls string")
    found = similar.similar_sets(df, "id", "item", threshold=0.6, least=5, bucket=bucket)
    big = {k: s for k, s in sets.items() if len(s) >= 5}
    expected = {(a, b) for a, b in combinations(sorted(big), 2) if len(big[a] & big[b]) / len(big[a] | big[b]) >= 0.6}
    links = Counter(x for p in expected for x in p)
    got = {r.id: r.links for r in found.links().collect()}
    assert got == {k: links[k] for k in big}
    members = {r.id: r.cls for r in found.members.collect()}
    assert all(big[a] == big[members[a]] for a in big)
    bodies = spark.createDataFrame([(k, bytes([k % 3])) for k in big if k % 7], "id long, body binary")
    pairs = {tuple(r) for r in queries.different_bodies(found, bodies).collect()}
    assert pairs == {(a, b) for a, b in expected if a % 7 and b % 7 and a % 3 != b % 3}


def test_similar_sets_empty(spark):
    found = similar.similar_sets(spark.createDataFrame([], "id long, item binary"), "id", "item")
    assert found.links().count() == found.pairs.count() == 0


# --- frequencies ----------------------------------------------------------------


def occurrences(n=400):
    out = set()
    for _ in range(n):
        out.add((rng.randrange(30), item(rng.choice([1, 1, 1, 2, 3, rng.randrange(60)])), rng.choice([None, *range(8)])))
    return sorted(out, key=str)


def brute_runs(occ, n):
    by = defaultdict(list)
    for r, t, p in occ:
        by[r].append((-1 if p is None else p, t))
    count, holders = Counter(), defaultdict(set)
    for r, row in by.items():
        seq = [t for _, t in sorted(row)]
        for i in range(len(seq)):
            for k in range(1, n + 1):
                if i + k <= len(seq):
                    run = tuple(seq[i : i + k])
                    count[run] += 1
                    holders[run].add(r)
    return {run: (c, len(holders[run])) for run, c in count.items()}


@pytest.mark.parametrize("n, hot", [(1, False), (1, True), (2, True), (3, False)])
def test_term_counts(spark, monkeypatch, n, hot):
    if hot:
        monkeypatch.setattr(frequency, "heavy_hashes", lambda df, c: [df.sparkSession.range(1).select(F.xxhash64(F.lit(item(1)))).first()[0]])
    occ = occurrences()
    data = occ + occ[:60] + [(None, item(1), 0), (1, None, 0)]
    df = spark.createDataFrame(data, "id long, t binary, off long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in frequency.term_counts(df, "id", "t", "off", n).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({r[:n] for r in got})
    assert {tuple(bytes(x) for x in r[:n] if x is not None): r[n:] for r in got} == brute_runs(occ, n)


def test_marks_and_text_terms(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (2, "b", 1)], "id long, t string, off long")
    rows = frequency.marked(frequency.term_counts(df, "id", "t", "off"), 2, 1.0)
    assert {(r.t1, r.mark) for r in rows.collect()} == {("a", "common"), ("b", "rare")}
    assert frequency.term_counts(df.limit(0), "id", "t", "off", 2).count() == 0


# --- distinctive terms ----------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_distinctive(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(distinctive, "heavy_hashes", lambda df, c: [df.sparkSession.range(1).select(F.xxhash64(F.lit(item(1)))).first()[0]])
    occ = occurrences(500)
    tf = Counter((r, t) for r, t, _ in occ)
    spread = Counter(t for _, t in tf)
    df = spark.createDataFrame(occ + occ[:40], "id long, t binary, off long")
    scores = distinctive.distinctive_terms(df, "id", "t", "off", 40)
    got = {(r.record, bytes(r.term)): r for r in scores.collect()}
    assert {k: (r.occurrences, r.spread) for k, r in got.items()} == {k: (n, spread[k[1]]) for k, n in tf.items()}
    for (r, t), x in got.items():
        assert x.weight == pytest.approx(tf[r, t] * math.log(40 / spread[t])) and 0 <= x.elite <= 1
    best = {(r.record, bytes(r.term)) for r in distinctive.most_distinctive(scores, 5).collect()}
    expected = set()
    for r in {r for r, _ in tf}:
        own = {t: got[r, t].weight for rr, t in tf if rr == r}
        shared = {t: w for t, w in own.items() if spread[t] >= 2}
        if len(own) >= 5 and shared:
            expected |= {(r, t) for t, w in shared.items() if w == pytest.approx(max(shared.values()))}
    assert best == expected
    assert distinctive.distinctive_terms(df.limit(0), "id", "t", "off", 0).count() == 0


def test_two_poisson_tells_two_rates():
    draw = np.random.default_rng(1)
    sample = np.concatenate((draw.poisson(0.2, 9000), draw.poisson(6.0, 1000)))
    count, n = np.unique(sample[sample > 0], return_counts=True)
    share, high, low = distinctive.fit_two_poisson(np.zeros(len(count), int), count, n, len(sample), 200)
    assert share[0] == pytest.approx(0.1, abs=0.01) and high[0] == pytest.approx(6, abs=0.3) and low[0] == pytest.approx(0.2, abs=0.03)
    posterior = distinctive.elite_posterior(np.array([1, 8]), share, high, low)
    assert posterior[0] < 0.1 and posterior[1] > 0.99


# --- most frequent --------------------------------------------------------------


def test_top_values(spark):
    values = [None] * 10 + ["a"] * 5 + ["c"] * 3 + ["b"] * 3 + [str(i) for i in range(79)]
    df = spark.createDataFrame([(v, 0) for v in values], "value string, n int")
    assert [tuple(r) for r in heavy.top_values(df, "value", 3).collect()] == [("a", 5), ("b", 3), ("c", 3)]
    assert {r.value for r in heavy.values_above(df, "value", 0.03).collect()} == {"a", "b", "c"}
    assert heavy.values_above(df.limit(0), "value", 0.01).count() == 0


# --- leaked items ---------------------------------------------------------------


def brute_leaks(docs, items, run):
    grams = lambda t: {tuple(w[i : i + run]) for w in [leakage.words(t)] for i in range(len(w) - run + 1)}
    held = [(i, grams(t)) for i, t in items if i is not None and t is not None]
    return {(d, i) for d, t in docs if d is not None and t is not None for i, g in held if g & grams(t)}


@pytest.mark.parametrize("run, span, part", [(12, 4, 1 << 20), (6, 2, 300), (5, 1, 1 << 20)])
def test_leaked_items(spark, run, span, part):
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(4, 60))) for i in range(25)]
    items.append((90, items[0][1] + text(5)))
    docs = []
    for d in range(120):
        body = text(rng.randrange(0, 120))
        if d % 2:
            w = rng.choice(items)[1]
            k = rng.randrange(len(w))
            body += w[k : k + rng.randrange(run - 2, run + 9)] + text(10)
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(x if rng.random() < 0.8 else x[0].upper() + "­" + x[1:] for x in body)))
    docs += [docs[1], (200, None), (None, docs[1][1]), (201, ""), (202, "x" * 100_000)]
    items = [(i, " ".join(w)) for i, w in items] + [(91, None), (92, ""), (93, "too short")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:2] for r in leakage.leaked_items(d, i, run=run, span=span, part=part).collect()]
    assert set(got) == brute_leaks(docs, items, run) and got
    assert Counter(got)[got[0]] >= 1
    assert leakage.leaked_items(d, i.limit(0)).count() == leakage.leaked_items(d.limit(0), i).count() == 0


def test_retrieve_finds_all_above_threshold():
    texts = [(n, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40)))) for n in range(300)]
    index = leakage.Index(texts, 3, 1)
    for _ in range(100):
        query = sorted({rng.randrange(len(index.terms)) for _ in range(rng.randrange(1, 6))})
        score = Counter()
        for t in query:
            for n, s in zip(*index.postings(t)[:2]):
                score[n] += s
        threshold = rng.choice(list(score.values()))
        assert sorted(index.retrieve(query, threshold - 1e-9)) == sorted(n for n, s in score.items() if s >= threshold - 1e-9)


def test_retrieval_decides_and_misses_nothing():
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 50)))) for n in range(200)]
    index = leakage.Index(texts, 12, 4)
    asked = []
    retrieve = index.retrieve
    index.retrieve = lambda terms: asked.append(retrieve(terms)) or asked[-1]
    numbers = leakage._Numbers()
    docs = [numbers.of(" ".join(rng.choice(vocabulary) for _ in range(30)) + " " + " ".join(t.split()[5:18])) for _, t in texts]
    got = {(d, i) for d, i, _, _ in index.leaks(np.concatenate(docs), np.cumsum([len(d) for d in docs]))}
    assert got == {(d, n) for d, x in enumerate(docs) for n in range(len(index.ids)) if index.runs_of(n) & {x[i : i + 12].tobytes() for i in range(len(x) - 11)}}
    assert asked and sum(map(len, asked)) < 20 * len(asked)
    index.retrieve = lambda terms: []
    assert not list(index.leaks(np.concatenate(docs), np.cumsum([len(d) for d in docs])))


@pytest.mark.parametrize("n", [5_001, 100_000])
def test_one_scan_for_any_number_of_items(spark, n):
    text = lambda i: " ".join(f"w{i * 7919 % 65521 + k * k % 13}x{(i + k) % 3001}" for k in range(14))
    items = spark.createDataFrame([(i, text(i)) for i in range(n)], "item_id long, text string").repartition(8)
    docs = spark.createDataFrame([(d, f"before {text(d * 37)} after") for d in range(100)] + [(1000, "nothing of it " * 50)], "doc_id long, text string")
    found = leakage.leaked_items(docs, items, part=1 << 20)
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(d, d * 37) for d in range(100)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation") + plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


# --- mixing ---------------------------------------------------------------------


def test_flow():
    flow = mixing.least_cost_flow({("a",): 10, ("a", "b"): 10, ("c",): 4}, {"a": 15, "b": 5, "c": 20, "d": 1}, {"a": 2, "b": 2, "c": 3, "d": 9})
    assert sum(f for (_, s), f in flow.items() if s == "a") == 15
    assert sum(f for (_, s), f in flow.items() if s == "b") == 5
    assert sum(f for (_, s), f in flow.items() if s == "c") == 12  # three times what there is
    assert flow[("a",), "a"] == 10 and flow[("a", "b"), "a"] == 5  # nothing is used twice as long as there is something unused
    assert mixing.least_cost_flow({}, {"a": 3}, {"a": 2}) == {} == mixing.least_cost_flow({("a",): 5}, {"a": 3}, {"a": 0})


def cheapest_paths(capacity, quota, repeats):
    """Greatest flow and its least cost, one cheapest augmenting path after another (Bellman and Ford)."""
    arcs = []  # from, to, left, cost; the arc after an even one is its reverse

    def arc(a, b, most, cost=0):
        arcs.extend([[a, b, most, cost], [b, a, 0, -cost]])

    for p, n in capacity.items():
        for k in range(1, sum(repeats[s] for s in p) + 1):
            arc("from", p, n, k)
        for s in p:
            arc(p, s, n * repeats[s])
    for s, q in quota.items():
        arc(s, "to", q)
    total = cost = 0
    while True:
        far, via = {"from": 0}, {}
        for _ in range(len(capacity) + len(quota) + 2):
            for i, (a, b, left, c) in enumerate(arcs):
                if left and a in far and far[a] + c < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + c, i
        if "to" not in far:
            return total, cost
        path, x = [], "to"
        while x != "from":
            path.append(via[x])
            x = arcs[via[x]][0]
        amount = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= amount
            arcs[i ^ 1][2] += amount
        total, cost = total + amount, cost + amount * far["to"]


def test_flow_is_greatest_and_cheapest():
    for _ in range(60):
        names = "abcde"[: rng.randrange(1, 6)]
        capacity = {tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))): rng.randrange(1, 30) for _ in range(rng.randrange(1, 8))}
        quota, repeats = {s: rng.randrange(0, 120) for s in names}, {s: rng.randrange(0, 9) for s in names}
        flow = mixing.least_cost_flow(capacity, quota, repeats)
        used = Counter()
        for (p, s), f in flow.items():
            assert 0 < f <= capacity[p] * repeats[s] and s in p
            used[p] += f
        assert all(sum(f for (_, s), f in flow.items() if s == x) <= quota[x] for x in names)
        price = lambda f, n: sum(min(n, f - i * n) * (i + 1) for i in range(-(-f // n)))
        assert (sum(flow.values()), sum(price(f, capacity[p]) for p, f in used.items())) == cheapest_paths(capacity, quota, repeats)


def test_flow_of_many_patterns_and_repeats():
    names = [f"s{i}" for i in range(60)]
    capacity = {}
    while len(capacity) < 20_000:
        capacity[tuple(sorted(rng.sample(names, rng.randrange(1, 7))))] = rng.randrange(1, 10**6)
    total = sum(capacity.values())
    quota = {s: total // 40 if i < 40 else total // 4000 for i, s in enumerate(names)} | {"s0": total}
    began = time.perf_counter()
    flow = mixing.least_cost_flow(capacity, quota, {s: 10**6 if i % 2 else 3 for i, s in enumerate(names)})
    assert time.perf_counter() - began < 60
    got = Counter()
    for (_, s), f in flow.items():
        got[s] += f
    assert all(got[s] == q or s == "s0" for s, q in quota.items()) and got["s0"] > 0


def test_mix(spark):
    docs = [(i, rng.choice([" A ", "a", "B"]), rng.randrange(1, 50)) for i in range(600)] + [(1000 + i, "c", 10) for i in range(20)]
    docs += [docs[0], (5000, "unlisted", 9), (5001, None, 9), (5002, "a", None), (None, "a", 4)]
    df = spark.createDataFrame(docs, "id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.2, 3), ("d", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, targets, seed=3, buckets=8)
    plan = {r.source: r for r in mix.plan.collect()}
    total = sum(t for i, s, t in set(docs) if i is not None and t and s and s.strip().lower() in "abcd")
    assert {s for s, r in plan.items() if r.short} == {s for s, r in plan.items() if r.max_repeats * r.tokens < r.target_share * total} == {"c", "d"}
    chosen = mix.chosen.collect()
    used = Counter()
    for r in chosen:
        used[r.source] += r.tokens * r.repeats
        assert 0 < r.repeats <= plan[r.source].max_repeats
    for s, r in plan.items():
        assert abs(used[s] - r.routed) <= 50
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7), targets, seed=3, buckets=8).chosen.collect()))
    report = {r.source: r for r in mix.report().collect()}
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)
    empty = mixing.mix_sources(df.limit(0), targets)
    assert empty.chosen.count() == 0 and empty.plan.count() == 4


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id int, text string")
    got = {r.id: r.tokens for r in tokens.with_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# --- truncation -----------------------------------------------------------------


def prose(n):
    nouns = ["house", "river", "garden", "engine", "window", "market"]
    out = ""
    while len(out) < n:
        out += " ".join(["The", rng.choice(nouns), "near", "a", rng.choice(nouns), "keeps", str(rng.randrange(10**6)), rng.choice(nouns)]) + ". "
    return out.strip()


def test_truncation(spark):
    docs, cut = [], set()
    closed = b"<html><body>...</body></html>\n"
    for i in range(900):
        text = prose(rng.randrange(80, 700))
        text += rng.choice(["", "", "\nRead more ...", "\nHome | Contact | Search", "\nBack to top"])
        source = rng.choice(["one", " One", "two", None])
        body, headers = closed, "HTTP/1.1 200 OK"
        whole = text
        if (source or "").strip().lower() == "one" and len(text) > 400:
            text = text[:400] if rng.random() < 0.5 else text[:397] + "..."
        elif i % 23 == 0:
            text, body = text[: rng.randrange(40, 75)], rng.choice([b"<html><body>...", None])
        bare = text.removesuffix("...").rstrip()
        if text != whole and "\n" not in text and not bare.endswith("."):
            cut.add(i)
        docs.append((i, text, source, headers, body))
    docs += [(901, None, "one", None, None), (902, " \n ", "one", None, b""), (903, "x" * 200_000, "two", None, None), (None, "a b c d", "one", None, None)]
    docs.append((904, "Fine.", "two", "HTTP/1.1 200 OK\nContent-Length: 9999", b"short"))
    docs.append((905, "The plain body stops in", "two", "HTTP/1.1 200 OK\nContent-Length: 9999", b"short"))
    cut.add(905)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, headers string, raw_bytes binary").withColumn("cut", F.lit(1))
    found = truncation.find_truncated(df)
    limits = {(r.source, r.unit, r.length) for r in found.limits.collect()}
    assert limits >= {("one", "chars", 400), ("one", "bytes", 400)}
    got = {r.id for r in found.found.collect()}
    assert len(cut & got) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    rates = {r.source: r for r in found.rates.collect()}
    assert sum(r.cut for r in rates.values()) == len(got) and set(rates) == {"one", "two", ""}
    none = truncation.find_truncated(df.limit(0))
    assert none.found.count() == none.limits.count() == none.rates.count() == 0


def _found(spark, docs):
    """Reasons of the cut texts of (id, text, source, raw_bytes)."""
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, raw_bytes binary").withColumn("headers", F.lit("HTTP/1.1 200 OK"))
    return {r.id: r.reason for r in truncation.find_truncated(df).found.collect()}


def test_copies_of_a_cut_text_are_found(spark):
    closed = b"<html><body>...</body></html>"
    docs = [(i, prose(rng.randrange(300, 3000)) + "\nBack to our top page", "one", closed) for i in range(200)]
    limit = [prose(500)[:449] + "n" for _ in range(60)]
    docs += [(1000 + i, limit[0] if i < 40 else limit[i - 40], "two", closed) for i in range(100)]
    docs += [(2000 + i, f"See www{i}.example.org now.\nThe river near a window kee", "one", b"<html><body>...") for i in range(100)]
    docs += [(3000 + i, "Some notice.\nThe garden near an engi", "one", None) for i in range(100)]
    docs += [(4000 + i, "Nothing was found here.\nHome page", "one", closed) for i in range(100)]  # whole, of one length by copying alone
    got = _found(spark, docs)
    assert {i for i in got if i < 1000} == set() == {i for i in got if i >= 4000}
    assert {i for i, r in got.items() if r == "limit"} == set(range(1000, 1100))
    assert {i for i, r in got.items() if r == "transfer"} == set(range(2000, 2100))
    assert {i for i, r in got.items() if r == "ending"} == set(range(3000, 3100))


def test_endings_without_blanks_and_in_tables(spark):
    docs = [
        (1, "标题\n这条河流经过城市的旧花园并且一直向北", "a", None),  # cut
        (2, "标题\n这条河流经过城市的旧花园。", "a", None),
        (3, "标题\n他说：「这条河流经过城市的旧花园。」", "a", None),
        (4, "标题\n返回顶部", "a", None),
        (5, "版权所有 | 隐私政策 | 联系我们", "a", None),
        (6, "Names.\nAnna | 34 | keeps the engine near the old riv", "a", None),  # cut
        (7, "Names.\nHome page | Terms of use | Privacy and cookies", "a", None),
        (8, "Names.\nWe keep cookies for the good of all readers here. More | Accept", "a", None),
        (9, "ชื่อ\nแม่น้ำไหลผ่านสวนเก่าของเมือง", "a", None),
    ]
    assert _found(spark, docs) == {1: "ending", 6: "ending"}
    rows = [(i, prose(rng.randrange(300, 3000)), "b", None) for i in range(200)]
    rows += [(1000 + i, (prose(300)[:300] + "\nThe engine of the " + "".join(rng.choices("aeiou", k=12)) + " | old garden window | " + "market " * 40)[:380], "b", None) for i in range(50)]
    assert {i for i, r in _found(spark, rows).items() if r == "limit"} == set(range(1000, 1050))


def test_tags_anywhere_in_the_body(spark):
    bodies = {
        1: b" " * 5000 + b"<HTML><body>...",  # broken
        2: b"<html><body>...</body></html><!-- " + b"x" * 5000 + b" --><script>y()</script>\n",
        3: b"<html><script>w('<html></html>')</script><p>...",  # broken
        4: b"<html><!-- </html> --><p>...",  # broken
        5: b" " * 5000 + b"<html><body>...</HTML>" + b"\n" * 200,
        6: b"",
    }
    docs = [(i, f"Read.\n{'abcdefg'[i]} river", str(i), body) for i, body in bodies.items()]
    assert _found(spark, docs) == dict.fromkeys((1, 3, 4), "transfer")


def test_length_limits_ignore_smooth_lengths(spark):
    rows = [("s", "chars", 100 + rng.randrange(400)) for _ in range(4000)] + [("s", "chars", 300)] * 120
    found = truncation.length_limits(spark.createDataFrame(rows, "source string, unit string, length int"))
    assert [r.length for r in found.collect()] == [300]


def test_byte_lengths_of_halved_characters(spark):
    text = ("д" * 30).encode()[:41].decode("utf-8", "replace")
    df = spark.createDataFrame([(text,)], "t string").select(truncation._lengths(F.col("t"))["bytes"].alias("n"))
    assert df.first().n == 41


def test_cut_texts_do_not_depend_on_other_pages(spark):
    docs = [(1, "Some notice.\nThe garden near an engi", "a", None), (2, "Names.\nBack to our first page", "a", None), (3, "Closed.\nBack to our first page", "a", b"<html>x</html>"), (4, "Shown.\nOur river meets the old gard", "a", b"<html>x</html>")]
    alone = _found(spark, docs)
    assert alone == {1: "ending"}
    more = [(100 + i, prose(rng.randrange(300, 3000)) + rng.choice(["", "\nThe garden near an engi"]), "b", None) for i in range(3000)]
    assert {i: r for i, r in _found(spark, docs + more).items() if i < 100} == alone


def test_very_long_lines_and_marks(spark):
    docs = [
        (1, "river " * 50_000 + "garden" + " ..." * 300, "a", None),  # cut
        (2, "river " * 50_000 + "garden." + "\"')" * 3000, "a", None),
        (3, "river " * 50_000 + " " * 50_000 + "( " * 20_000 + "gard", "a", None),  # cut
        (4, "river garden window." + "." * 100_000, "a", None),
        (5, "the old river keeps" + "." * 100_000, "a", None),  # cut, with a long mark
        (6, "..." * 1000, "a", None),
    ]
    assert _found(spark, docs) == {1: "ending", 3: "ending", 4: "ending", 5: "ending"}


def test_texts_without_a_source_have_the_limits_of_all(spark):
    closed = b"<html><body>...</body></html>"
    docs = [(i, (prose(700)[:449] + "n")[:450] if i < 60 else prose(rng.randrange(300, 3000)), "s", closed) for i in range(200)]
    docs += [(500, prose(700)[:449] + "n", None, closed), (501, prose(700)[:447] + "n", None, closed)]
    got = _found(spark, docs)
    assert got[500] == "limit" and 501 not in got


def test_similar_large_sets_in_one_bucket(spark):
    """A thousand sets of one family, some of 10,000 members, that meet in the same buckets."""
    draw = np.random.default_rng(4)
    core = draw.integers(0, 1 << 40, 10_000)
    sets = {}
    for i in range(12):  # similar to each other in steps
        sets[i] = set(np.concatenate((core[: 10_000 - 300 * i], draw.integers(1 << 41, 1 << 42, 300 * i))).tolist())
    for i in range(1000):
        own = core[draw.choice(200, 30, replace=False)]
        sets[100 + i] = set(np.concatenate((own, draw.integers(1 << 41, 1 << 42, 6))).tolist())
        if i % 10 == 0:
            sets[2000 + i] = set(list(sets[100 + i])[3:])
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, items array<long>").select("id", F.explode("items").alias("item"))
    got = {(r.a, r.b) for r in similar.similar_sets(df, "id", "item", bucket=2).pairs.collect()}
    expected = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a]) * 0.6 <= len(sets[b]) <= len(sets[a]) / 0.6 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 - 1e-9}
    assert got <= expected and len(got) >= 0.99 * len(expected) and len(expected) > 130


def test_finer_keys_meet_for_similar_sets(spark):
    """Members and finer bands each miss nothing on their side of the boundary, and are not too many."""
    draw = np.random.default_rng(5)
    for size in (10, 60, 70, 100, 110, 200):
        a = np.unique(draw.integers(0, 1 << 50, size))
        b = np.unique(np.concatenate((a[: int(size * 0.8)], draw.integers(1 << 51, 1 << 52, int(size * 0.15)))))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.6
        classes = spark.createDataFrame([(1, a.tolist()), (2, b.tolist())], "cls long, items array<long>")
        large = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "key long, cls long")
        for depth in (1, 2):
            keys = defaultdict(Counter)
            for r in similar._finer(large, classes, 0.6, depth, a[:3].tolist()).collect():
                keys[r.cls][r.key] += 1
            assert set(keys[1]) & set(keys[2]) and sum(keys[2].values()) <= 1500


def test_a_record_with_a_third_of_all_rows(spark):
    data = [(i, i * 7 % 50 + j) for i in range(3000) for j in range(6)] + [(5000, j % 6) for j in range(30_000)]
    df = spark.createDataFrame(data, "id long, item long").repartition(4)
    found = similar.similar_sets(df, "id", "item")
    assert {r.id: r.cls for r in found.members.collect()}[5000] == 0


def test_a_term_with_a_third_of_all_rows(spark, monkeypatch):
    data = [(i, item(1), i % 3) for i in range(25_000)] + [(i % 5000, item(2 + i % 300), i % 7) for i in range(30_000)]
    df = spark.createDataFrame(data, "id long, t binary, off long").repartition(4)
    rows = lambda x: sorted((tuple(bytes(v) if isinstance(v, bytearray) else round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=str)
    assert len(distinctive.heavy_hashes(df.select("t"), "t")) == 1
    scores, counts = rows(distinctive.distinctive_terms(df, "id", "t", "off", 25_000)), rows(frequency.term_counts(df, "id", "t", "off"))
    for module in (distinctive, frequency):
        monkeypatch.setattr(module, "heavy_hashes", lambda df, c: [])
    assert scores == rows(distinctive.distinctive_terms(df, "id", "t", "off", 25_000)) and counts == rows(frequency.term_counts(df, "id", "t", "off"))


def test_mix_of_odd_targets(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", -3, "x"), (3, "a", None, "x"), (4, "b", 5, "x")], "id long, source string, tokens long, pattern string")
    targets = spark.createDataFrame(
        [("a", 0.5, 2, 1), (" A", 0.9, 9, 1), ("b", float("nan"), 3, 1), ("c", None, None, 1), ("d", -1.0, -1, 1), (None, 0.5, 1, 1), ("e", float("inf"), 1, 1)], "source string, target_share double, max_repeats int, k int"
    )
    mix = mixing.mix_sources(docs, targets)
    plan = {r.source: (r.tokens, r.quota, r.routed, r.short) for r in mix.plan.collect()}
    assert plan == {" A": (5, 9, 9, False), "b": (5, 0, 0, False), **dict.fromkeys("cde", (0, 0, 0, False))}
    assert {(r.id, r.source, r.repeats) for r in mix.chosen.collect()} >= {(1, " A", 2)}
    assert mixing.mix_sources(docs, targets.limit(0)).chosen.count() == 0


def test_truncation_without_headers_and_bodies(spark):
    docs = spark.createDataFrame([(1, "Fine.\nThe river near a window kee", "a", 1), (2, "Fine.", "a", 2), (2, "Fine.", "a", 2), (3, None, None, None)], "doc_id long, text string, source string, shape int")
    found = truncation.find_truncated(docs, headers=None, body=None)
    assert [tuple(r) for r in found.found.collect()] == [(1, "a", "ending")]
    assert {(r.source, r.texts, r.cut) for r in found.rates.collect()} == {("a", 3, 1), ("", 1, 0)}
