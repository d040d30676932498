"""Plain versions of the operators, for small inputs: written from the contracts, without the operators' code."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in out)
    return *(sum(k == i for _, k, _ in out) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined


def shingle_set(text, n):
    w = words(lower_ascii(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(rows, n, percent=80):
    """{doc_id: component_id} for rows (doc_id, text); rows with the same id are one document."""
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t, n)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


def repeats(rows, window=50):
    """{row number: (n_bytes, n_removed, n_spans, kept bytes)}"""
    first = {}
    data = [(d, (t or "").encode("utf-8")) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - window + 1):
                s = b[i : i + window]
                first[s] = min(first.get(s, d), d)
    out = {}
    for r, (d, b) in enumerate(data):
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - window + 1):
                if first[b[i : i + window]] < d:
                    gone[i : i + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[r] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def quality_counts(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def _class(c):
    if c in "abcdefghijklmnopqrstuvwxyz":
        return 0
    if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        return 1
    if c in "0123456789":
        return 2
    if c in " \t\n\r\x0b\x0c":
        return 3
    if c in ".,;:!?'\"()-":
        return 4
    if c in "#*$%&|<>@[]\\^_`{}~+=/":
        return 5
    return 7 if ord(c) > 127 else 6


def _histograms(text, common):
    lowered = [w.strip(".,;:!?'\"()-") for w in words(lower_ascii(text or ""))]
    classes, own = Counter(map(_class, text or "")), Counter(common.get(w, len(common)) for w in lowered)
    return [classes[i] for i in range(8)], [own[i] for i in range(len(common) + 1)]


def _jensen_shannon(p, q):
    p, q = [x / max(sum(p), 1e-12) for x in p], [x / max(sum(q), 1e-12) for x in q]
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) for x in (a, b) if x > 0)
    return math.sqrt(max(0.0, total / 2))


def quality_verdicts(rows, common, most_class=0.3, most_word=0.35, least_documents=20):
    """[(counts, base_failed, kept)] for rows (text, lang)."""
    sums, of = defaultdict(lambda: [[0] * 8, [0] * (len(common) + 1)]), Counter()
    for text, lang in rows:
        if len(words(text)) >= 50:
            for key in {lang or "", ""}:
                of[key] += 1
                for into, own in zip(sums[key], _histograms(text, common)):
                    total = max(sum(own), 1)
                    for i, x in enumerate(own):
                        into[i] += x * 1_000_000 // total
    out = []
    for text, lang in rows:
        c = quality_counts(text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        ref = sums.get(lang if lang and of[lang] >= least_documents else "")
        far = False
        if ref:
            classes, own = _histograms(text, common)
            far = len(text or "") >= 200 and _jensen_shannon(classes, ref[0]) > most_class or c[0] >= 100 and _jensen_shannon(own, ref[1]) > most_word
        out.append((c, failed, not failed and not far))
    return out


def line_templates(line, long_documents=2):
    """[(template, documents that make it recur)]"""
    tokens = ["<*>" if re.search("[0-9@]", t) else t for t in line.split()]
    if not tokens:
        return []
    n, half = len(tokens), (len(tokens) - 2) // 2
    constant = lambda ts: sum(t != "<*>" for t in ts)
    enough = lambda ts: 4 * constant(ts) >= len(ts)
    out = [((0, n, *tokens) if enough(tokens) else (3, line), long_documents if n > 50 else 3)]
    if n >= 12:
        out += [((k, n, *part), 3) for k, part in ((1, tokens[: 2 + half]), (2, tokens[:2] + tokens[2 + half :])) if enough(part)]
    elif constant(tokens) >= 5:
        out += [((0, n, *tokens[:p], "<*>", *tokens[p + 1 :]), 3) for p in range(n) if tokens[p] != "<*>"]
    return out


def drop_lines(rows, long_documents=2):
    """[(n_lines, n_dropped, kept text)] for rows (doc_id, text); every row has an id."""
    have, least = defaultdict(set), {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            for k, n in line_templates(line, long_documents):
                have[k].add(d)
                least[k] = min(n, least.get(k, n))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not any(len(have[k]) >= least[k] and min(have[k]) != d for k, _ in line_templates(x))]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def leak_words(text):
    return re.sub("[!-/:-@\\[-`{-~]", " ", (text or "").lower()).split()


def alignment(a, b):
    """The best Smith-Waterman score, by the whole table."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            best = max(best, new[-1])
        row = new
    return best


def pack_pieces(doc_id, ids, most=1024):
    out, at = [], 0
    while at < len(ids):
        n = most
        while n > len(ids) - at:
            n //= 2
        piece = ids[at : at + n]
        out.append((doc_id, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)), len(ids)))
        at += n
    return out


def greedy_pieces(word, vocabulary):
    """Greedy longest match over symbols; 1 if the word can't be cut."""
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if tuple(word[at:end]) in vocabulary:
                at, n = end, n + 1
                break
        else:
            return 1
    return n


def leaks(docs, items, least=0.5):
    """{(doc_id, item_id): score} for rows (doc_id, text) and (item_id, text) with different ids."""
    out = {}
    for d, t in docs:
        b = leak_words(t)
        have = set(b)
        for item, x in items:
            a = leak_words(x)
            # A score of half the item needs at least that many of its words.
            if len(a) >= 3 and sum(w in have for w in a) >= least * len(a) and (score := alignment(a, b) / len(a)) >= least:
                out[d, item] = score
    return out


def classifier_features(text, common):
    """{slot: value}: hashed words, then twenty statistics."""
    import xxhash

    text = text or ""
    marks = ".,;:!?'\"()-"
    words_ = [w for w in (x.strip(marks) for x in words(lower_ascii(text))) if w]
    n = Counter(xxhash.xxh3_64_intdigest(w.encode()) >> 50 for w in words_)
    norm = math.sqrt(sum(n.values()))
    out = {k: math.sqrt(v) / norm for k, v in n.items()}
    c = quality_counts(text)
    classes, own = _histograms(text, common)
    lines = [x for x in text.split("\n") if words(x)]
    w = words(text)
    per = 1 / max(c[0], 1)
    stats = [
        *(x * 1_000_000 // max(sum(classes), 1) / 1e6 for x in classes), 1 - own[-1] * per, min(1, c[1] * per / 12), min(1, c[2] * per), c[3] / max(len(lines), 1), c[4] * per, min(1, len(set(w)) * per), min(1, math.log1p(c[0]) / 12),
        min(1, math.log1p(len(lines)) / 8), min(1, c[0] / max(len(lines), 1) / 100), sum(x.rstrip(" \t\n\r\x0b\x0c")[-1:] in list(".!?") for x in lines) / max(len(lines), 1), sum("A" <= x[0] <= "Z" for x in w) * per, min(1, math.log1p(sum(classes)) / 14),
    ]
    return out | {(1 << 14) + i: float(x) for i, x in enumerate(stats)}


def classifier_scores(docs, labels, common, k=8, epochs=12, rate=0.05, decay=1e-5, batch=64, seed=7):
    """{doc_id: score}: a factorisation machine with all pairs of features, learnt row by row from labels {doc_id: 0 or 1}; every id is in one row."""
    import numpy as np

    each = {d: classifier_features(t, common) for d, t in docs}
    rows = [({i: float(np.float32(x)) for i, x in sorted(each[d].items())}, labels[d]) for d in sorted(each) if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    size, rng = (1 << 14) + 20, np.random.default_rng(seed)
    bias, linear, factors = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, k))
    good = sum(y for _, y in rows) / len(rows)
    weight = {1: (0.5 / good) ** 0.5, 0: (0.5 / (1 - good)) ** 0.5}
    g0, g1, g2 = 1e-8, np.full(size, 1e-8), np.full((size, k), 1e-8)

    def raw(x):
        i, v = np.array(list(x)), np.array(list(x.values()))
        f = factors[i] * v[:, None]
        gram = f @ f.T
        return bias + linear[i] @ v + (gram.sum() - np.trace(gram)) / 2, f.sum(0)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            d0, d1, d2 = 0.0, defaultdict(float), defaultdict(lambda: np.zeros(k))
            for x, y in part:
                score, total = raw(x)
                err = (1 / (1 + math.exp(-score)) - y) * weight[y] / len(part)
                d0 += err
                for i, v in x.items():
                    d1[i] += err * v
                    d2[i] += err * v * (total - factors[i] * v)
            g0 += d0 * d0
            bias -= rate * d0 / g0**0.5
            for i in d1:
                a, b = d1[i] + decay * linear[i], d2[i] + decay * factors[i]
                g1[i] += a * a
                g2[i] += b * b
                linear[i] -= rate * a / g1[i] ** 0.5
                factors[i] -= rate * b / np.sqrt(g2[i])
    return {d: 1 / (1 + math.exp(-raw(x)[0])) for d, x in each.items()}
