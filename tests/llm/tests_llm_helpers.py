"""Brute-force versions of operators, for several test modules."""

import math
import re
from collections import Counter


def shingles(text, n=5):
    """The runs of n words of a text and how often they occur; all words of a shorter text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))) if words else Counter()


def brute_classes(texts, weighting="set"):
    sets = [{(x, k) for x, n in shingles(t).items() for k in range(n if weighting == "count" else 1)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def brute_leaks(docs, items, min_score, min_overlap):
    """Every item piece scored against every passage, by words, without index, bounds or hashes."""

    def words_of(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())

    def order(part, passage):
        row = [0] * (len(passage) + 1)
        for w in part:
            before = 0
            for j, v in enumerate(passage, 1):
                before, row[j] = row[j], max(row[j - 1], before + 1 if v == w else row[j])
        return row[-1] / len(part) if part else 1.0

    def runs(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    known = {i: w for i, t in items if (w := words_of(t))}
    pieces = []
    for i, w in known.items():
        n = -(-len(w) // 64)
        size, more, at = len(w) // n, len(w) % n, 0
        for k in range(n):
            to = at + size + (k < more)
            pieces.append((i, Counter(w[at:to]), to - at))
            at = to
    df, mean = Counter(t for _, tf, _ in pieces for t in tf), sum(n for *_, n in pieces) / max(len(pieces), 1)
    weighed = []
    for i, tf, n in pieces:
        w = {t: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) * math.log1p((len(pieces) - df[t] + 0.5) / (df[t] + 0.5)) for t, f in tf.items()}
        weighed.append((i, w, sum(w.values())))
    out = {}
    for d, t in docs:
        words = words_of(t)
        n = len(words)
        for s in range(0, n, 64):
            if s and s + 64 >= n:
                continue
            seen = set(words[s : s + 128])
            for i, w, own in weighed:
                score = sum(v for t, v in w.items() if t in seen) / own
                if score < min_score:
                    continue
                item = known[i]
                lo, to = (max(0, s - len(item)), min(n, min(n, s + 128) + len(item))) if len(item) > 64 else (s, min(n, s + 128))
                cut = max(1, (3 * len(item) + 3) // 4)
                part = words[lo:to]
                if len(item) < 2:
                    ok = part == item
                else:
                    run = min(5, len(item))
                    ok = bool(runs(item, run) & runs(part, run)) and order(item[:cut], part) >= min_overlap and order(item[cut:], part) >= min_overlap
                if ok:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out
