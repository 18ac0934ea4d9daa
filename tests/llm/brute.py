"""Plain, slow versions of the corpus operators, written apart from them."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(docs):
    """docs: list of (id, text). {id: (keep, size)}"""
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t])) for i, t in norm.items()}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near(docs, n, similarity):
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    common = {}
    for ids in holders.values():
        for a, b in combinations(sorted(ids), 2):
            common[a, b] = common.get((a, b), 0) + 1
    for (a, b), c in common.items():
        if 10_000 * c >= round(similarity * 10_000) * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def contaminated(docs, items, size=10):
    """{id: (n_words, hit word numbers, item ids as strings)}"""
    queries = []
    for key, text in items:
        w = bench_words(text)
        queries += [("null" if key is None else str(key), tuple(w[i : i + size])) for i in range(max(1, len(w) - size + 1))] if w else []
    out = {}
    for i, text in docs:
        w, hits, found = bench_words(text), set(), set()
        places = {}
        for k in {len(q) for _, q in queries}:
            for p in range(len(w) - k + 1):
                places.setdefault(tuple(w[p : p + k]), []).append(p)
        for key, q in queries:
            for p in places.get(q, ()):
                hits.update(range(p, p + len(q)))
                found.add(key)
        out[i] = (len(w), sorted(hits), sorted(found))
    return out


def url(rules, address, default="allow"):
    rest = address.split("://", 1)[1] if address and "://" in address else None
    if rest is None:
        return "", "", None, default
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UP)
    fit = [(len(h.split(".")), len(p), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    return host, path, *max(fit)[2:]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)) + [None]


class NgramCounts:
    """Counts of a list of texts; "<" is the begin, None the end."""

    def __init__(self, texts):
        self.word, self.pair, self.begins = Counter(), Counter(), 0
        for t in texts:
            ws = _tokens(t)
            self.begins += 1
            self.word.update(ws)
            self.pair.update(zip(["<"] + ws[:-1], ws))
        self.total = sum(self.word.values())

    def context(self, w):
        return self.begins if w == "<" else self.word[w]


def _bucket(n):
    return int(math.floor(math.log2(1 + n)))


def _rounded(p):
    """To quarters of an octave, 2^-48 at least; 0 stays 0."""
    return 2.0 ** (-min(1 + round(-4 * math.log2(p)), 192) / 4 + 0.25) if p > 0 else 0.0


def interpolation_weights(counted, held_out, rounds=100, tied=20.0):
    """Weights (pair, word, uniform) by bucket, by EM on the held-out texts under the counts of the others."""
    c = NgramCounts(counted)
    v = len(set(c.word) | set(NgramCounts(held_out).word))
    seen = Counter()
    for t in held_out:
        ws = _tokens(t)
        for a, b in zip(["<"] + ws[:-1], ws):
            n = c.context(a)
            seen[_bucket(n), _rounded(c.pair[a, b] / n if n else 0), _rounded(c.word[b] / max(c.total, 1))] += 1
    start = (0.4, 0.55, 0.05)

    def climb(cells, at, prior):
        for _ in range(rounds):
            got = list(prior)
            for (p2, p1), n in cells:
                parts = [at[0] * p2, at[1] * p1, at[2] / (v + 1)]
                for k in range(3):
                    got[k] += n * parts[k] / sum(parts)
            at = [x / sum(got) for x in got]
        return at

    by = {}
    for (b, p2, p1), n in seen.items():
        by.setdefault(b, []).append(((p2, p1), n))
    weights = {b: start for b in range(65)}
    if seen and counted:
        together = climb([x for cells in by.values() for x in cells], start, [1e-3] * 3)
        weights = {b: climb(by.get(b, []), together, [w * tied for w in together]) for b in range(65)}
    w = weights[0]
    weights[0] = (0.0, w[1] / (1 - w[0]), w[2] / (1 - w[0]))
    return weights


def lm_scores(docs, learn, deleted):
    """{id: (n_tokens, n_known, train_tokens, base, score)}; ``deleted`` says which of the texts learned from are held out."""
    rows = [(i, t) for i, t in docs if learn(i)]
    weights = interpolation_weights([t for i, t in rows if not deleted(i)], [t for i, t in rows if deleted(i)])
    c = NgramCounts([t for _, t in rows])
    n, v, out = c.total, len(c.word), {}
    for i, t in docs:
        ws, score, base = _tokens(t), 0.0, 0.0
        for a, b in zip(["<"] + ws[:-1], ws):
            k = c.context(a)
            w = weights[_bucket(k)]
            score += math.log10(w[2] / (v + 1) + w[1] * c.word[b] / n + (w[0] * c.pair[a, b] / k if k else 0))
            base += math.log10((c.word[b] + 0.5) / (n + 0.5 * (v + 1)))
        out[i] = (len(ws), sum(c.word[x] > 0 for x in ws), n, base, score)
    return out


def lm_scores_by_others(docs, learn, deleted):
    """{id: score} under the same weights, each text by the counts of the other texts that are learned from."""
    rows = [(i, t) for i, t in docs if learn(i)]
    weights = interpolation_weights([t for i, t in rows if not deleted(i)], [t for i, t in rows if deleted(i)])
    c, out = NgramCounts([t for _, t in rows]), {}
    v = len(c.word)
    for i, t in docs:
        ws, own, score = _tokens(t), NgramCounts([t] if learn(i) else []), 0.0
        n = c.total - own.total
        for a, b in zip(["<"] + ws[:-1], ws):
            k = c.context(a) - own.context(a)
            w = weights[_bucket(k)]
            p = w[2] / (v + 1)
            if n:
                p += w[1] * (c.word[b] - own.word[b]) / n
            if k:
                p += w[0] * (c.pair[a, b] - own.pair[a, b]) / k
            score += math.log10(p)
        out[i] = score
    return out


def _sentence_words(text):
    return [set(re.findall(r"[^\W\d_]+", s.lower())) for s in re.findall(r"[^.!?\n]+", text or "")]


def noisy_or_fit(docs, rounds=200, prior=2.0):
    """docs: list of (text, toxic). (hazards, leak) by EM sentence by sentence."""
    bags = [(_sentence_words(t), y) for t, y in docs]
    in_docs, in_toxic, shown = Counter(), Counter(), Counter()
    for ss, y in bags:
        for w in set().union(*ss):
            in_docs[w] += 1
            in_toxic[w] += y
        for s in ss:
            shown.update(s)
    h = {w: in_toxic[w] / (shown[w] + prior) for w in in_docs if in_docs[w] >= 3 and in_toxic[w] >= 2}
    if not any(y for _, y in bags):
        return {}, 0.0
    leak = 0.1  # as a hazard
    toxic = [[[w for w in s if w in h] for s in ss] for ss, y in bags if y]
    for _ in range(rounds):
        got, got_leak = dict.fromkeys(h, 0.0), 0.0
        for ss in toxic:
            hazards = [sum(h[w] for w in s) for s in ss]
            p_doc = -math.expm1(-max(sum(hazards) + leak, 1e-12))
            for s, total in zip(ss, hazards):
                if total:
                    p_sentence = -math.expm1(-total)
                    of_sentence = p_sentence / p_doc
                    for w in s:
                        got[w] += of_sentence * h[w] / p_sentence
            got_leak += leak / p_doc
        h = {w: g / (shown[w] + prior) for w, g in got.items()}
        leak = got_leak / (len(bags) + 20)
    return h, -math.expm1(-leak)


def noisy_or_score(model, text):
    """(score, scores of the sentences)"""
    h, leak = model
    each = [-math.expm1(-sum(h.get(w, 0.0) for w in s)) for s in _sentence_words(text)]
    return 1 - (1 - leak) * math.prod(1 - p for p in each), each
