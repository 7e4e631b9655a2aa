"""Plain Python twins of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def held(doc_id, n, r):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == r


def near(rows, k, percent):
    """{doc_id: (set size, component)}; ids are distinct."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeated(rows, least):
    """{doc_id: word positions inside a passage of `least` words that another document has}."""
    at = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - least + 1):
            at[tuple(w[j : j + least])].append((i, j))
    out = defaultdict(set)
    for spots in at.values():
        if len({i for i, _ in spots}) > 1:
            for i, j in spots:
                out[i].update(range(j, j + least))
    return out


def kneser_ney(train, texts):
    """(base, score, tokens, known) of each text under the interpolated modified Kneser-Ney bigram model."""
    uni, bi = Counter(), Counter()
    for t in train:
        w = [*words(t), None]
        uni.update(w)
        bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    cont = Counter(b for _, b in bi)
    total, kinds = Counter(), defaultdict(Counter)
    for (a, _), c in bi.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1

    def discounts(counts):
        m = [sum(c == i for c in counts) for i in range(1, 5)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] else 0.5
        raw = [1 - 2 * y * m[1] / m[0] if m[0] else 0.5, 2 - 3 * y * m[2] / m[1] if m[1] else 1.0, 3 - 4 * y * m[3] / m[2] if m[2] else 1.5]
        return [0.0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))]

    d2, d1 = discounts(bi.values()), discounts(cont.values())
    every = sum(cont.values())
    below = sum(d1[min(c, 3)] for c in cont.values()) / every if every else 1.0

    def p(a, b):
        low = max(cont[b] - d1[min(cont[b], 3)], 0) / max(1, every) + below / (v + 1)
        if not total[a]:
            return low
        back = sum(d2[k] * m for k, m in kinds[a].items()) / total[a]
        return max(bi[a, b] - d2[min(bi[a, b], 3)], 0) / total[a] + back * low

    out = []
    for t in texts:
        w = [*words(t), None]
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((base, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), len(w), sum(uni[x] > 0 for x in w)))
    return out, p, [*uni], n


def groups(rows, k, percent):
    """[(set size, component)] for each row, whose ids may repeat or be null: the component is its least id that is not null."""
    found = near([(j, t) for j, (_, t) in enumerate(rows)], k, percent)
    least = {}
    for j, (i, _) in enumerate(rows):
        if i is not None:
            c = found[j][1]
            least[c] = min(i, least.get(c, i))
    return [(found[j][0], least.get(found[j][1])) for j in range(len(rows))]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target}: shared by weight; whatever passes its cap is cut to it and shared again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def base_spans(text):
    """[(start, kind, end)] of the base secrets, in the order of the digest."""
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    found = [(m.start(), n, kind, m.end()) for n, (kind, p, group, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m[group]) >= least]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def quality_statistics(text):
    """The transformed statistics of a text, one after another."""
    text = text or ""
    data, w = text.encode(), words(text)
    count = lambda chars: sum(data.count(c.encode()) for c in chars)
    upper, lower = (count(map(chr, range(a, a + 26))) for a in (65, 97))
    size, n, lines = len(data), len(w), data.count(b"\n")
    ratio = lambda a, b, mean, weight=20.0: math.log((a + mean * weight) / (b + weight))
    return [
        math.log1p(n), ratio(count("*$%&#@^~<>{}[]\\/=+_|!"), size, 0.002, 100), ratio(upper, upper + lower, 0.05, 50),
        ratio(sum(len(x.encode()) for x in w), n, 6.0, 10), ratio(sum(a == b for a, b in zip(w, w[1:])), n, 0.01), ratio(len(set(w)), n**0.9, 1.0),
        ratio(count(".,;:?"), n, 0.15), ratio(count("0123456789"), size, 0.002, 100), ratio(count("|"), n, 0.002, 50), ratio(count("!"), n, 0.002, 50),
        ratio(lines, n, 0.03), ratio(n, lines + 1, 25.0, 1),
    ]


def quality(rows, labels, shrink, floor, temperature):
    """[score] of each row by the two normal densities with shrunk covariances, by inverse and determinant."""
    import numpy as np

    x = np.array([quality_statistics(t) for _, t in rows])
    y = np.array([labels.get(i, -1) if not held(i, 3, 1) else -1 for i, _ in rows])
    logs, total = [], (y >= 0).sum()
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T, bias=True)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(len(cov))
        d = x - own.mean(0)
        logs.append(math.log(len(own) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    return 1 / (1 + np.exp((logs[0] - logs[1]) / temperature))


def readings(written, table, separators):
    """Each way to read a written word: (word, kinds of steps), by trying all of them."""
    if not written:
        return [("", ())]
    ch, out = written[0].lower(), []
    rest = readings(written[1:], table, separators)
    options = [(c, "changed") for c in table.get(ch, "")] + ([(ch, "same")] if "a" <= ch <= "z" else [])
    for said, steps in rest:
        out += [(c + said, ((kind, c), *steps)) for c, kind in options]
        out += [(said, (("again", c, kind), *steps)) for c, kind in options]
        if ch in separators or ch == "!" or not options:
            out.append((said, (("dropped",), *steps)))
    return out


def decoded(written, table, separators, model, changed, dropped, repeated):
    """The word of the best reading, its value by the trigram model."""
    best = (-math.inf, "")
    for _, steps in readings(written, table, separators):
        a, b, value, said, good = 0, 0, 0.0, "", True
        for s in steps:
            if s[0] == "dropped":
                value += dropped
            elif s[0] == "again":  # a repetition of the letter before
                good = good and ord(s[1]) - 96 == b
                value += repeated
            else:
                c = ord(s[1]) - 96
                value += model[a, b, c] + (changed if s[0] == "changed" else 0.0)
                a, b, said = b, c, said + s[1]
        if good and value + (model[a, b, 0] if b else 0.0) > best[0] + 1e-12:
            best = (value + (model[a, b, 0] if b else 0.0), said)
    return best[1]


def toxic_features(text, restored):
    """Words and their beginnings of 4 and 5 bytes, of a text and of its restored words."""
    out = set()
    for said in (text or "", *restored):
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", said.translate(LOWER).encode()):
            out.add((0, w))
            out |= {(k, w[:k]) for k in (4, 5) if len(w) > k}
    return out


def toxicity(rows, labels, restored, prior_rows, bucket):
    """[(evidence, label or None)] of each row: log-odds of features over the labelled rows that are not held out.

    Features that fall into the same bucket are one.
    """
    features = [{bucket(*x) for x in toxic_features(t, r)} for (_, t), r in zip(rows, restored, strict=True)]
    y = [None if i is None or held(i, 5, 0) else labels.get(i) for i, _ in rows]
    n = [sum(v == c for v in y) for c in (0, 1)]
    prior = (n[1] + 0.5) / (sum(n) + 1)
    counts = defaultdict(lambda: [0, 0])
    for f, v in zip(features, y, strict=True):
        for x in f if v is not None else ():
            counts[x][v] += 1
    weight = {}
    for x, (a, b) in counts.items():
        p = (b + prior_rows * prior) / (a + b + prior_rows)
        weight[x] = math.log(p / (1 - p)) - math.log(prior / (1 - prior))
    out = []
    for f, v in zip(features, y, strict=True):
        top = sorted((weight.get(x, 0.0) for x in f), reverse=True)[:2]
        out.append((sum(s * max(w, 0.0) for s, w in zip((1.0, 0.5), top)), v))
    return out
