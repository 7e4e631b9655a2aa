"""Operators against plain twins of their whole results, on given documents and on odd rows."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import decontamination, lm, near_dup, quality, repeats, secrets, toxicity
from attestry.llm.exact_dedup import drop_copies, exact_dedup
from attestry.llm.mixing import mix_documents, source_targets
from attestry.llm.queries import QUERIES

from . import brute
from .test_operators import ODD, SMALL, frame, labels

PLAIN = [(i, t) for i, t, _ in ODD]


@pytest.fixture(scope="module")
def pairs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def truth(spark):
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}


def same(found, want):
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_quality_twin(spark, pairs, truth):
    rows = [*pairs, *PLAIN]
    docs = frame(spark, [(*r, "s") for r in rows])
    known = {i: q for i, (q, _) in truth.items()}
    got = quality.quality_scores(docs, labels(spark, [(i, q, 0) for i, q in known.items()]))
    want = brute.quality(rows, known, quality.SHRINK, quality.FLOOR, quality.TEMPERATURE)
    key = lambda x: (str(x[0]), x[1])
    pairs_ = zip(sorted(((r.doc_id, r.score, r.held_out, r.predicted) for r in got.collect()), key=key), sorted(((i, s) for (i, _), s in zip(rows, want)), key=key), strict=True)
    for (i, score, aside, predicted), (j, s) in pairs_:
        assert i == j and math.isclose(score, s, abs_tol=1e-6) and aside == brute.held(i, 3, 1) and predicted == (score >= 0.5)


@pytest.mark.parametrize("written", ["l0ser", "$tup1d", "1d10t", "m o", "i.d.i", "moorn", "p4th", "a!", "h@t3", "5", "b-b"])
def test_decode_twin(spark, written):
    text = "you are a stupid loser and an idiot. the moron was here with pathetic clown trash " * 50
    model = toxicity.letter_model(spark.createDataFrame([(text,)], "text string"))
    want = brute.decoded(written, toxicity.READINGS, toxicity.SEPARATORS, model, toxicity.CHANGED, toxicity.DROPPED, toxicity.REPEATED)
    assert toxicity.decode(written, model) == want


def test_toxicity_twin(spark, pairs, truth):
    rows = [*pairs, *[(i, t) for i, t in PLAIN if i != 8]]
    known = {i: t for i, (_, t) in truth.items()}
    docs = frame(spark, [(*r, "s") for r in rows])
    model = toxicity.letter_model(docs)
    restored = []
    for _, t in rows:
        data, offsets = toxicity.raw(pa.array([t], pa.string()))
        said = set()
        for _, a, b in zip(*(x.tolist() for x in toxicity.suspects(data, offsets)), strict=True):
            written = data[a:b].tobytes().decode("utf-8", "ignore")
            said.add(toxicity.decode(written, model))
            if any(c in toxicity.SEPARATORS for c in written):
                said.add(toxicity.decode(written, model, True))
        restored.append([s for s in said if len(s) > 2])

    def bucket(size, word):
        h = toxicity.span_hashes(np.frombuffer(word, np.uint8))(np.array([0]), np.array([len(word)]))
        return int(toxicity.mix(h, 20 + {0: 0, 4: 1, 5: 2}[size])[0]) >> 42

    want = brute.toxicity(rows, known, restored, toxicity.PRIOR_ROWS, bucket)
    counts = {}
    for z, y in want:
        if y is not None:
            counts[math.floor(z * 10), y] = counts.get((math.floor(z * 10), y), 0) + 1
    cut = toxicity.best_cut(counts)
    got = toxicity.toxicity_scores(docs, labels(spark, [(i, 0, t) for i, t in known.items()])).collect()
    key = lambda x: (str(x[0]), x[1])
    a = sorted(((r.doc_id, r.score) for r in got), key=key)
    b = sorted(((i, 1 / (1 + math.exp(cut - z))) for (i, _), (z, _) in zip(rows, want, strict=True)), key=key)
    assert [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-5)  # weights are kept in 32 bits


def test_targets_twin(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, "d": 500, None: 77}, {"x": 5}, {"a": 0, "b": 9}, {"Z": 100, "a": 100, "é": 1, "": 40_000}):
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in source_targets(table).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mixing_of_documents(spark, pairs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes = {}
    for i, t in pairs:
        sizes[source[i]] = sizes.get(source[i], 0) + len(brute.words(t))
    want, taken = brute.targets(sizes), {}
    for r in QUERIES["op3_source_mixing"](spark, SMALL).collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9) and r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)


def test_base_secrets_of_documents(spark, pairs):
    extra = [(10**6, "Token: " + "x" * 500 + " 😀 API_KEY='abcdefgh' passwd=short" + " AKIA" + "Q" * 40), (10**6 + 1, None), (10**6 + 2, "f" * 70_000)]
    rows = [*pairs, *extra]
    for r in secrets.scan_secrets(frame(spark, [(*x, "s") for x in rows])).collect():
        want = brute.base_spans(dict(rows)[r.doc_id])
        said = [f"{k}:{a}:{b}" for a, k, b in want]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in want) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(","))


def test_exact_dedup_of_odd_rows(spark):
    want = []
    for i, t in PLAIN:
        group = [j for j, u in PLAIN if (u or "") == (t or "")]
        top = max((j for j in group if j is not None), default=None)
        want.append((i, top, len(group), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    same(exact_dedup(frame(spark)), want)
    stay = sorted(max((j for j, u in PLAIN if j is not None and (u or "") == t), default=-1) for t in {t or "" for _, t in PLAIN})
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in drop_copies(frame(spark)).collect()) == stay


def test_near_duplicates_of_odd_rows(spark):
    want = [(i, n, i if n == 0 else c) for (i, _), (n, c) in zip(PLAIN, brute.groups(PLAIN, 5, 80), strict=True)]
    same(near_dup.near_duplicates(frame(spark)).drop("text_hash"), want)
    stay = [i for i, _, c in want if i is None or c is None or c >= i]
    assert sorted(map(str, stay)) == sorted(str(r.doc_id) for r in near_dup.drop_near_duplicates(frame(spark)).collect())


def test_language_model_of_odd_rows(spark):
    train = [t for i, t in PLAIN if not brute.held(i, 10, 0)]
    want, _, _, n = brute.kneser_ney(train, [t for _, t in PLAIN])
    rows = [(i, brute.held(i, 10, 0), w[2], w[3], n, round(w[0], 6), round(w[1], 6)) for (i, _), w in zip(PLAIN, want, strict=True)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.lm_scores(frame(spark)).collect()]
    for a, b in zip(sorted(got, key=str), sorted(rows, key=str), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-6)


def test_odd_rows_without_results(spark):
    copies = spark.createDataFrame([(1, "one two three four five six"), (2, "zzz"), (3, None), (None, "A b")], "item_id long, text string")
    same(repeats.repeated_passages(frame(spark)), [])
    got = decontamination.contaminated(frame(spark), copies).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == {(5, 1), (6, 1), (None, 1), (9, None)}
    left = decontamination.drop_contaminated(frame(spark), copies).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted(((i, t) for i, t in PLAIN if not (t or "").startswith(("one two", "A b"))), key=str)


def test_short_items(spark):
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in range(1, 13)]
    rows = [(n, f"before it {t} and after", "s") for n, t in items] + [(20, "w3x0 w3x2 w5x0 w5x1 w5x3 w5x4", "s")]
    found = decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(n, n) for n, _ in items}


@pytest.mark.parametrize("columns", [("gone_id", "gone_hash"), ("__id", "__hash"), ("hash", "sha"), ("row", "suspect")])
def test_clashing_columns(spark, columns):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, "x"), (2, "a b c d e f g", 2, "y"), (3, "h", None, None)], f"doc_id long, text string, {columns[0]} long, {columns[1]} string")
    items = spark.createDataFrame([(1, "h")], "item_id long, text string")
    for out, stay in (
        (drop_copies(docs), [2, 3]), (near_dup.drop_near_duplicates(docs), [1, 3]), (decontamination.drop_contaminated(docs, items), [1, 2]),
        (quality.keep_quality(docs, labels(spark, [(i, 1, 0) for i in range(50)])), [1, 2, 3]), (repeats.drop_repeated_passages(docs), [1, 2, 3]),
    ):
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == stay


def test_families_below_the_threshold(spark):
    """Sets that are alike, some linked to the first of their family, some to each other, most to none."""
    import random

    rows = []
    for f in range(6):
        r = random.Random(f)
        family = [[f"f{f}_{r.randrange(10**6)}" for _ in range(r.choice([60, 150]))]]
        for _ in range(25):
            w = list(r.choice(family) if r.random() < 0.5 else family[0])
            for _ in range(r.randrange(1, 14)):
                w[r.randrange(len(w))] = f"e{r.randrange(30)}"
            family.append(w)
        rows += [(100 * f + i, " ".join(w)) for i, w in enumerate(family)]
    for k, percent in ((3, 90), (2, 60), (1, 40)):
        found = near_dup.near_duplicates(frame(spark, [(*r, "s") for r in rows]), k=k, percent=percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.near(rows, k, percent)


@pytest.mark.parametrize("first", [1, 5000])
def test_small_groups_open_large_ones(spark, first):
    """The members of a large group do not each open the small groups around it, whichever has the smaller name."""
    large, small = [(1000 + i, 1000) for i in range(300)], [(first + i, first + i) for i in range(20)]
    groups = spark.createDataFrame(large + small, "cls long, g long")
    hits = spark.createDataFrame([(c, 60, 0.2, list(range(12))) for c, _ in large + small], "cls long, n long, w double, items array<long>")
    got = sorted((r.a, r.b) for r in near_dup._opened(hits, groups, 90).collect())
    assert [p for p in got if p[1] == 1000] == [(c, 1000) for c, _ in small]
    assert len(got) == 20 + 20 * 19 // 2


def test_cutting_repeats_keeps_one_copy(spark):
    passage = " ".join(f"q{i}" for i in range(60))
    rows = [(1, f"a b c {passage} d e", "s"), (2, f"f {passage} g", "s"), (3, " ".join(f"r{i}" for i in range(90)), "s"), (4, None, "s")]
    found = {r.doc_id: (r.start_word, r.end_word, r.stays) for r in repeats.repeated_passages(frame(spark, rows)).collect()}
    assert found[1][:2] == (3, 63) and found[2][:2] == (1, 61) and found[1][2] != found[2][2]
    cut = {r.doc_id: r.text for r in repeats.drop_repeated_passages(frame(spark, rows)).collect()}
    assert cut[3] == rows[2][1] and cut[4] is None
    for i in (1, 2):
        assert (cut[i] == rows[i - 1][1]) == found[i][2]
        assert found[i][2] or len(cut[i].split()) <= len(rows[i - 1][1].split()) - repeats.SURE


@pytest.mark.parametrize("chunk", [200_000, 25])
def test_components(spark, monkeypatch, chunk):
    import random

    from attestry.llm import shared

    monkeypatch.setattr(shared, "CHUNK_EDGES", chunk)
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(60)]
    top = {}
    for a, b in edges:
        for x in (a, b):
            top.setdefault(x, x)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        top[q] = p
    got = {x.node: x.label for x in shared.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_items_do_not_depend_on_each_other(spark):
    """Parts of an item, scattered over a long text, are no repeat of it, whatever other items there are."""
    item = [f"part{i}" for i in range(12)]
    filler = [f"filler{i}" for i in range(2700)]
    scattered = list(filler)
    for i in range(0, 12, 3):
        scattered[200 + 200 * i : 203 + 200 * i] = item[i : i + 3]
    rows = [(1, " ".join(scattered), "s"), (2, "x " * 40 + " ".join(item), "s")]
    long = (2, " ".join(f"other{i}" for i in range(4000)))
    found = [
        sorted((r.doc_id, r.item_id, r.score, r.word_start) for r in decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
        for items in ([(1, " ".join(item))], [(1, " ".join(item)), long])
    ]
    assert found[0] == found[1] and [x[:2] for x in found[0]] == [(2, 1)]


def test_near_matches_of_items(spark):
    """An item with some words changed is found as long as its rarest words and most grams of both halves are there."""
    rng = random.Random(8)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randrange(20, 300)))) for i in range(30)]
    rows = []
    for i, text in items:
        words = text.split()
        for share in (0.03, 0.6):
            changed = [w if rng.random() >= share else "changed" for w in words]
            rows.append((1000 * int(share > 0.5) + i, " ".join(["before"] * rng.randrange(400) + changed + ["after"] * 50), "s"))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    grams = lambda x: {tuple(x[j : j + 3]) for j in range(len(x) - 2)}
    for doc_id, text, _ in rows:
        w, have = dict(items)[doc_id % 1000].split(), grams(text.split())
        halves = w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]
        least = min(len(grams(x) & have) / len(grams(x)) for x in halves)
        if abs(least - 0.5) > 1e-9:
            assert ((doc_id, doc_id % 1000) in found) == (least > 0.5), least
    assert all(a % 1000 == b for a, b in found)


def test_separators_of_any_length(spark):
    rows = [(1, "user:" + " " * 5 + "bob pass=x1y2z", "s"), (2, "login" + " " * 90 + "= carol host :  h.example.org pwd" + " " * 30 + ":secretive", "s")]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert got[1].n_linked == 2 and got[1].spans.startswith("ident:0:13,key:14:")
    assert got[2].n_linked == 3


def plain_links(text, scope=secrets.SCOPE):
    """The weak candidates of a text whose complement stands within scope code points, by comparing all with all."""
    base = secrets.base_spans(text)
    role = {"assign": "key", "access": "ident", "hex": "key"}
    weak = [(k, m.start(), m.end()) for k, p in secrets.WEAK.items() for m in p.finditer(text) if not any(s <= m.start() and m.end() <= e for s, _, e in base)]
    every = [(role[secrets.KINDS[k]], s, e) for s, k, e in base] + weak
    near = lambda a, kind: any(k == kind and s <= a[2] + scope and e >= a[1] - scope for k, s, e in every)
    return sorted(w for w in weak if (near(w, "key") if w[0] == "ident" else near(w, "ident") if w[0] == "key" else near(w, "ident") and near(w, "key")))


def test_links_of_documents(spark, pairs):
    rng = random.Random(4)
    stock = ["user: bob ", "pass=x1y2z ", "https://h.example.org/x ", "host = db.example.org ", "AKIA" + "Q" * 17 + " ", "0123456789abcdef0 ", "login=" + "z" * 30 + " ", "plain words here "]
    made = [(10**6 + i, "".join(rng.choice(stock) + "f " * rng.randrange(0, 90) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    rows = [*pairs, *made]
    linked = 0
    for r in secrets.scan_secrets(frame(spark, [(*x, "s") for x in rows])).collect():
        text = dict(rows)[r.doc_id] or ""
        want = [f"{k}:{s}:{e}" for k, s, e in plain_links(text)]
        base = {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.base_spans(text)}
        assert sorted(x for x in r.spans.split(",") if x and x not in base) == sorted(want)
        linked += len(want)
    assert linked > 100


def test_settings_are_put_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for value in ("64m", "1kb", "67108864b"):
            spark.conf.set(name, value)
            assert len(secrets.scan_secrets(frame(spark)).collect()) and spark.conf.get(name) == value
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_extensions_over_partitions(spark, monkeypatch, seed):
    """Each suffix against all of other documents with its key, with partitions of few rows and of one document only."""
    monkeypatch.setattr(repeats, "SORTED_ROWS", 3)
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        node = rng.choice([1, 1, 1, 1, 2, 3]) if seed < 3 else i % 7
        said = [rng.choice([5, 5, 5, 6]) for _ in range(repeats.WINDOW)]
        if rng.random() < 0.5:
            said = [5] * repeats.WINDOW if node != 1 else [4] * repeats.WINDOW
        for j in range(rng.choice([repeats.WINDOW, repeats.WINDOW, 3]), repeats.WINDOW):
            said[j] = 0
        rows.append((node, i, rng.choice([7, 7, 8]), b"".join(w.to_bytes(4, "big") for w in said)))
    found = spark.createDataFrame(rows, "node long, pos long, key long, left binary")
    words_of = {r[1]: [r[3][4 * j : 4 * j + 4] for j in range(repeats.WINDOW)] for r in rows}

    def common(a, b):
        n = 0
        while n < repeats.WINDOW and a[n] == b[n] and a[n] != bytes(4):
            n += 1
        return n

    want = {
        (node, pos): max((common(words_of[pos], words_of[p]) for other, p, k, _ in rows if other != node and k == key), default=0)
        for node, pos, key, _ in rows
    }
    assert {(r.node, r.pos): r.more for r in repeats.extensions(found, "left").collect()} == want
