"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import ceil, floor, isfinite, log2, log10, sqrt
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def roots(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, size=3, percent=85):
    """{doc_id: (n_shingles, component)} of [(doc_id, text)]."""
    sets = {}
    for i, text in docs:
        w = words(lower(text or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[i] = frozenset(s)
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = []
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.append((i, j))
    root = roots(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def near_vectors(rows, least=0.93):
    """{vec_id: (n_links, component)} of [(vec_id, vector, label)]."""
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and isfinite(x) for x in v) and any(v):
            n = sqrt(sum(float(x) ** 2 for x in v))
            good[i] = (label, [x / n for x in v])
    links, items = [], sorted(good.items())
    for a, (i, (li, vi)) in enumerate(items):
        for j, (lj, vj) in items[a + 1 :]:
            if li == lj and len(vi) == len(vj) and sum(x * y for x, y in zip(vi, vj, strict=True)) >= least:
                links.append((i, j))
    count = Counter(x for pair in links for x in pair)
    root = roots([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], root[r[0]]) for r in rows}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return (
        n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def repeats(docs, size=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    data = {i: (t or "").encode() for i, t in docs}
    first = {}
    for i in sorted(data):
        for k in range(len(data[i]) - size + 1):
            first.setdefault(data[i][k : k + size], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\x01" * size
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def url(text, rules):
    """host, path, rule, verdict (None without rule)."""
    rest = text.split("://", 1)[1] if text and "://" in text else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if rest else ""
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host, best = lower(host), None
    for verdict, rule in rules:
        r_host, slash, r_path = rule.partition("/")
        if (host == r_host or host.endswith("." + r_host)) and path.startswith(slash + r_path):
            best = max(best or (0,), (len(rule), verdict == "block", rule, verdict))
    return (host, path, best[2], best[3]) if best else (host, path, None, None)


def lines(docs, least_chars=20, least_docs=3):
    """{doc_id: (n_lines, n_dropped, sha256)}."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(holders.get(key(x), ())) >= least_docs and i < max(holders[key(x)]))]
        out[i] = (len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score)}."""
    held = {i: crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    tokens = {i: [*words(lower(t or "")), None] for i, t in docs}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for i, w in tokens.items()
    }


def interpolated_scores(docs, role, buckets=24, rounds=200):
    """{doc_id: score} of trigrams, bigrams, unigrams and a floor, one token at a time.

    ``role`` of a doc_id: 0 held out, 1 training, 2 training and held out for the weights.
    """
    tokens = {i: [*words(lower(t or "")), "\n"] for i, t in docs}
    roles = {i: role(str(i)) for i in tokens}

    def counts(which):
        grams = Counter()
        for i, w in tokens.items():
            if roles[i] in which:
                padded = ["\t", "\t", *w]
                grams["\t", "\t"] += 1
                grams["\t",] += 1
                for k in range(2, len(padded)):
                    for n in (1, 2, 3):
                        grams[tuple(padded[k - n + 1 : k + 1])] += 1
        n = sum(len(w) for i, w in tokens.items() if roles[i] in which)
        return grams, n, len({x for i, w in tokens.items() if roles[i] in which for x in w})

    def estimates(w, grams, n, v):
        padded = ["\t", "\t", *w]
        for k in range(2, len(padded)):
            a, b, c = padded[k - 2 : k + 1]
            two, one = grams[a, b], grams[b,]
            of = lambda x: min(int(log2(x + 1)), buckets - 1)
            bucket = buckets + of(two) if two else of(one)
            yield bucket, (grams[a, b, c] / max(two, 1), grams[b, c] / max(one, 1), grams[c,] / max(n, 1), 1 / (v + 1))

    kept = counts({1})
    held = [x for i, w in tokens.items() if roles[i] == 2 for x in estimates(w, *kept)]
    weights = {}
    for b in range(2 * buckets):
        first = 0 if b >= buckets else 1 if b else 2
        mine = [p for at, p in held if at == b] or [p for _, p in held]
        weight = [0.0] * first + [1 / (4 - first)] * (4 - first)
        for _ in range(rounds):
            total = [0.0] * 4
            for p in mine:
                parts = [x * y for x, y in zip(weight, p, strict=True)]
                for k in range(4):
                    total[k] += parts[k] / sum(parts)
            weight = [(total[k] + 0.5) / (len(mine) + 0.5 * (4 - first)) if k >= first else 0.0 for k in range(4)]
        weights[b] = weight
    whole = counts({1, 2})
    return {i: sum(log10(sum(x * y for x, y in zip(weights[b], p, strict=True))) for b, p in estimates(w, *whole)) for i, w in tokens.items()}


CLASS_OF = {c: k for k, cs in enumerate([".,;:!?'\"()-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>_=+/\\@~^`{}[]"], 3) for c in cs}


def js_distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * log2(a / c) for a, c in zip(x, m, strict=True) if a)
    return sqrt(max((part(p) + part(q)) / 2, 0))


def divergence(docs, common):
    """{doc_id: (char distance, word distance, kept)} of [(doc_id, text, lang)], by the operator's default limits."""
    found = {}
    for i, text, lang in docs:
        w, chars, hits = words(text), [0] * 7, [0] * (len(common) + 1)
        for c in (c for x in w for c in x):
            chars[0 if "a" <= c <= "z" else 2 if ord(c) > 127 else CLASS_OF.get(c, 1)] += 1
        for x in w:
            known = x.lower() in common and x in (x.lower(), x.lower().capitalize())
            hits[common.index(x.lower()) + 1 if known else 0] += 1
        shares = [[x / max(sum(h), 1) for x in h] for h in (chars, hits)]
        found[i] = (lang, len(w), quality(text)[-1], *shares)
    mean = lambda rows: [sum(x) / len(rows) for x in zip(*rows, strict=True)]
    good = [f for f in found.values() if f[1] >= 100 and not f[2]]
    langs = {f[0] for f in good}
    of_chars, of_words = ({g: mean([f[k] for f in good if f[0] == g]) for g in langs} for k in (3, 4))
    of_all = mean([f[4] for f in good]) if good else None
    far, scaled = {}, defaultdict(list)
    for i, (lang, n, failed, chars, hits) in found.items():
        if n >= 50 and lang in langs:
            far[i] = js_distance(chars, of_chars[lang]), min(js_distance(hits, of_words[lang]), js_distance(hits, of_all))
            if not failed:
                scaled[lang, floor(log2(n / 50))].append(far[i][1] * sqrt(n))
    out = {}
    for i, (lang, n, failed, *_) in found.items():
        c, w = far.get(i, (None, None))
        bad = False
        if c is not None:
            like = sorted(scaled[lang, floor(log2(n / 50))])
            low, middle = (like[ceil(p * len(like)) - 1] for p in (0.25, 0.5)) if len(like) >= 30 else (0, float("inf"))
            beyond = w > 0.28 and w * sqrt(n) > middle + 4 * (middle - low) / 0.6745
            bad = c > 0.30 or (n >= 100 and c > 0.172 and w > 0.28) or beyond
        out[i] = (c, w, not failed and not bad)
    return out
