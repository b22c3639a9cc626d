import numpy as np

from tidemark.llm import bloom_cascade as U
from tidemark.llm import hnsw as V
from tidemark.llm import quality_classifier as Q
from tidemark.llm import quality_rules as R


def test_vectors_match_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base[:30] + r.normal(size=(30, 8)) * 0.08, base[:10]]))]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] + [0.0] * 6), (504, [float("nan")] * 8), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in V.near_duplicates(df).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: {j for j, y in good if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95} for i, x in good}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i] == (len(links.get(i, ())), min(reach), min(reach) == i), i
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_graph_finds_neighbours():
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = V.Graph(v)
    q, x, _, recall = V.audited(g, v, 0.7)
    truth = {tuple(p) for p in np.argwhere(v @ v.T >= 0.7)}
    assert recall >= 0.99 and len(truth & set(zip(q.tolist(), x.tolist(), strict=True))) >= 0.97 * len(truth)


def test_audit_pools_shards_and_weighs_a_hot_group_once(spark):
    r = np.random.default_rng(9)
    base = r.normal(size=(1200, 24))
    pairs = base[:90] + r.normal(size=(90, 24)) * 0.05  # a few vectors have one link
    hot = base[-1] + r.normal(size=(300, 24)) * 0.05  # and many one another
    v = np.concatenate([base, pairs, hot])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    true = unit @ unit.T >= 0.95
    np.fill_diagonal(true, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)

    record = {}
    got = {x.vec_id: x.n_links for x in V.near_duplicates(df, record=record).collect()}
    assert got == {i: int(n) for i, n in enumerate(true.sum(1))}
    assert record["linked"] == int(true.any(1).sum()) and record["queries"] == len(v) and record["recall"] >= V.RECALL
    assert 90 <= record["groups"] <= 95


def test_a_link_found_from_one_end_counts_at_both():
    import pyarrow as pa

    r = np.random.default_rng(3)
    x = r.normal(size=(40, 16))
    y = x + r.normal(size=(40, 16)) * 0.02
    made = []
    for shard, v in enumerate((x, y)):
        t = pa.table({"dims": [128] * 40, "shards": [2] * 40, "shard": [shard] * 40, "rep": list(range(100 * shard, 100 * shard + 40)), "n": [1] * 40, "vec": [w.tobytes() for w in v]})
        made.append(V._graphs(t))
    both = pa.concat_tables(made)
    near = V.Graph.near
    ends = []
    try:
        V.Graph.near = lambda self, q, least, width: (np.arange(len(q)), self.order[np.argmax(q @ self.v.T, 1)])
        asked = pa.table({"rep": list(range(40)), "vec": [w.tobytes() for w in x]})
        # A search that finds nothing but the query itself has a recall of 0.
        assert V._tallied(0.95, V.BEAM)(made[0], asked).num_rows == 0
        own = V._tallied(0.95, V.BEAM)(made[1], asked).to_pydict()
        assert own["low"] == list(range(100, 140)) and own["truth"] == own["got"] == [1] * 40
        for blind in (0, 1, 2):
            calls = iter(range(2))
            V.Graph.near = lambda self, q, least, width: (np.zeros(0, np.int64),) * 2 if next(calls) == blind else near(self, q, least, width)  # noqa: B023
            out = V._searched(0.95, V.BEAM)(both).to_pylist()
            ends.append(sorted((o["a"], o["n"]) for o in out if o["n"]))
    finally:
        V.Graph.near = near
    assert ends[0] == ends[1] == ends[2] == sorted((i, 1) for s in (0, 100) for i in range(s, s + 40))


def test_vectors_of_any_number_of_lengths(spark):
    df = spark.range(2010).selectExpr("id AS vec_id", "array_repeat(double(id % 2 + 1), int(id div 2 + 1)) AS embedding")
    got = [(x.vec_id, x.n_links, x.component_id) for x in V.near_duplicates(df).collect()]
    assert sorted(got) == [(i, 1, i - i % 2) for i in range(2010)]


def test_a_whole_shard_is_searched_by_its_graph(spark, monkeypatch):
    """Planted pairs among 1500 vectors of one shard; a damaged graph loses links and fails its audit."""
    r = np.random.default_rng(12)
    base = r.normal(size=(1300, 20))
    v = np.concatenate([base, base[:200] + r.normal(size=(200, 20)) * 0.05])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    true = unit @ unit.T >= 0.95
    np.fill_diagonal(true, False)
    monkeypatch.setattr(V, "LEAST_SHARDS", 1)
    record = {}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {x.vec_id: x.n_links for x in V.near_duplicates(df, record=record).collect()}
    assert record["width"] < 500 and got == {i: int(n) for i, n in enumerate(true.sum(1))} and true.sum() >= 350
    g = V.Graph(unit.astype(np.float32))
    q = unit[-100:].astype(np.float32)
    assert V.audited(g, q, 0.95)[2] == V.BEAM
    g.layers[-1][::2] = -1
    lost = V._near(g, q, 0.95, V.BEAM)
    assert len(lost[0]) < true[-100:].sum() + len(q) and V.audited(g, q, 0.95)[2] > V.BEAM


def test_cascade_is_exact():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 62, 5000).astype(np.uint64))
    listed, others = keys[:500], keys[500:]
    levels, inside, outside = [], listed, others
    while len(inside):
        levels.append(U.Bloom.empty(len(inside), len(levels), 0.2))
        words, bits = levels[-1].parts(inside)
        levels[-1].words[words] |= bits
        inside, outside = outside[levels[-1].has(outside)], inside
    assert len(levels) > 2
    c = U.Cascade(levels)
    assert c.has(listed).all() and not c.has(others).any() and not U.Cascade([]).has(others).any()


def test_urls(spark):
    urls = ["http://A.b.NET/x", "net", None, "http://net", "https://example.net/en/1?x#y", "http://www.example.com/de/", "http://example.com/DE/", "ftp://x.org/fr/z", "http://h.net?q://z", "://net/", "http://xnet/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*U.RULES, U.RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).orderBy("page_id").collect()]
    assert got == [("a.b.net", "/x", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"), ("example.net", "/en/1", "example.net/en/", "allow"), ("www.example.com", "/de/", "example.com/de/", "block"), ("example.com", "/DE/", None, "allow"), ("x.org", "/fr/z", "org/fr/", "allow"), ("h.net", "", None, "allow"), ("net", "/", "net/", "block"), ("xnet", "/", None, "allow")]
    assert U.judge(pages.limit(0), rules).count() == 0


def test_urls_beyond_a_levels_bound(spark, monkeypatch):
    """Lists larger than a level, thousands of path lengths and very long urls give what a join gives."""
    r = np.random.default_rng(6)
    hosts = [f"h{i}.com" for i in range(40)]
    rules = [(hosts[int(r.integers(40))], "/" + "a" * int(n), "block" if n % 3 else "allow") for n in range(4500)]
    urls = ["http://" + ("x." if n % 2 else "") + hosts[int(r.integers(40))] + "/" + "a" * int(n) + "b" for n in r.integers(0, 600, 40)] + ["http://h1.com/" + "a" * 4200 + "b" * 100_000, "http://" + "x." * 50 + "h2.com/aa"]
    monkeypatch.setattr(U, "MOST_BYTES", 8000)
    sizes = []
    build = U.build

    def seen(listed, universe):
        made = build(listed, universe, U.MOST_BYTES)
        sizes.extend(x.words.nbytes for x in made.levels)
        return made

    monkeypatch.setattr(U, "build", seen)
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    table = {}
    for h, p, v in rules:
        table[h, p] = "block" if "block" in (v, table.get((h, p))) else v
    for x in got.collect():
        h, path = x.host, x.path
        fits = [(len(s) + len(p), v, s + p) for s in {".".join(h.split(".")[i:]) for i in range(h.count(".") + 1)} for (s2, p), v in table.items() if s2 == s and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (x.verdict, x.rule) == best[1:], x.page_id
    assert len(sizes) > 4 and max(sizes) <= 8000 + 8


def test_rules_count_and_keep(spark):
    good = " ".join(f"the word{i} of" for i in range(40))
    rows = [(1, good), (2, None), (3, ""), (4, "a b c d " * 30), (5, " ".join(f"w{i}*** the" for i in range(60))), (6, "x\ny\nx\n\n \nx"), (1, good)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in R.judge(df).select("doc_id", "__q_m.*", "__q_base", "__q_kept").collect()}
    assert got[1]["__q_kept"] and not got[2]["__q_kept"] and not got[5]["__q_kept"]
    assert got[4].n_repeat_words == 120 and got[6].n_dup_lines == 2 and got[5].n_symbols == 180
    assert R.keep_good(df).count() == 2 and R.keep_good(df).columns == df.columns and R.judge(df.limit(0)).count() == 0


def test_network_learns_and_gradients_agree():
    r = np.random.default_rng(0)
    texts = [("abc def " * int(r.integers(1, 200)) if y else "a*** b&&& " * int(r.integers(1, 150))).encode() for y in (1, 0) * 60]
    net = Q.train(texts, np.array([1, 0] * 60), steps=60)
    join = lambda t: (np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)]))
    s = net.score(*join(texts))
    assert s[::2].min() > 0.5 > s[1::2].max() and len(net.score(*join([b""]))) == 1
    rows, owner = Q.chunked(*join(texts[:4]))
    y, w = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    fresh = Q.Network({k: v.astype(np.float64) for k, v in Q.Network.fresh(3).weights.items()})
    g = fresh.gradients(rows, owner, y, w)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := fresh.combine(fresh.features(rows), owner, 4), 1 - p)))
    for k, at in (("out", (3, 0)), ("mix", (5, 2)), ("chunk", (7, 4)), ("filters", (9, 11))):
        old = fresh.weights[k][at]
        fresh.weights[k][at] = old + 1e-5
        up = loss()
        fresh.weights[k][at] = old - 1e-5
        down = loss()
        fresh.weights[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3


def test_training_sees_all_of_a_long_text(spark, monkeypatch):
    long = "".join(chr(97 + i % 26) for i in range(30_000))
    docs = spark.createDataFrame([(i, long + str(i)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen, steps = [], []
    monkeypatch.setattr(Q, "train", lambda texts, y: seen.append(texts))
    Q.fit(docs, labels)
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 200_000)
    Q.fit(docs, labels)
    assert len(seen[0]) > len(seen[1]) == 6 and all(len(t) > 30_000 for texts in seen for t in texts)
    monkeypatch.undo()
    whole = Q.Network.gradients
    monkeypatch.setattr(Q.Network, "gradients", lambda self, rows, owner, *a: steps.append(np.bincount(owner)) or whole(self, rows, owner, *a))
    Q.train(seen[1][:2], np.array([0, 1]), steps=1, batch=4)
    assert (steps[0] == len(Q.chunk_starts(len(seen[1][0])))).all()


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 5000):
        seen = np.zeros(n, bool)
        for s in Q.chunk_starts(n):
            seen[s : s + Q.CHUNK] = True
        assert seen.all()
