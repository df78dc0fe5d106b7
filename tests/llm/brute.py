"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def repeats(rows, window=50):
    """doc_id, text -> (n_words, n_removed, sha256, kept words) per row."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


def shingles(text, k):
    w = ascii_lower(text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(rows, k, percent=80):
    """doc_id -> smallest doc_id reachable."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def bench_words(text):
    out, word = [], []
    for byte in ascii_lower(text or "").encode():
        if byte >= 128 or chr(byte).isalnum():
            word.append(byte)
        elif word:
            out.append(bytes(word))
            word = []
    return out + [bytes(word)] * bool(word)


def leaked(rows, items, percent=80, least=5):
    """(doc_id, item_id) pairs with a window of the item's size within its edits. Of m words at least m - k are untouched by k
    edits, so windows with fewer words of the item are not tried."""
    found = set()
    phrases = [(item, bench_words(phrase)) for item, phrase in items]
    for i, text in rows:
        w = bench_words(text)
        for item, m in phrases:
            k = len(m) * (100 - percent) // 100
            if len(m) < least:
                continue
            known, total = set(m), [0]
            for word in w:
                total.append(total[-1] + (word in known))
            for p in range(max(0, len(w) - (len(m) - k) + 1)):
                if total[min(p + len(m), len(w))] - total[p] >= len(m) - k and edit_distance(w[p : p + len(m)], m) <= k:
                    found.add((i, item))
                    break
    return found


def leaked_at_any_length(rows, items, percent=80, least=5):
    """(doc_id, item_id) pairs with a window of any size from m - k to m + k words within the item's k edits."""
    found = set()
    for i, text in rows:
        w = bench_words(text)
        for item, phrase in items:
            m = bench_words(phrase)
            k = len(m) * (100 - percent) // 100
            if len(m) < least:
                continue
            for p in range(max(0, len(w) - (len(m) - k) + 1)):
                near = w[p : p + len(m) + k]
                if len(set(m) & set(near)) < len(set(m)) - k:
                    continue
                if any(edit_distance(near[:n], m) <= k for n in range(len(m) - k, len(near) + 1)):
                    found.add((i, item))
                    break
    return found


def periodic(words, least=6, exponent=4):
    """(start, length, smallest period) of every run, by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                inside = words[i : j + q]
                if not any(inside[r:] == inside[:-r] for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_tail(doc_id, text):
    """The words that op13_periodic_runs looks at."""
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def periodic_digests(words):
    runs = periodic(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = tuple(hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept))
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


def divergence(rows, min_docs, top=50, smooth=5, scale=10**9):
    """Rows (lang, source, part, item, value, rank) from rows (text, lang, source)."""
    counts, docs_with, groups = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = [ascii_lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for term in found:
            key = (lang, source, term)
            counts[key] = counts.get(key, 0) + 1
        for term in set(found):
            docs_with[lang, term] = docs_with.get((lang, term), 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (of, t), n in docs_with.items() if of == lang and n >= min_docs)

        def usage(of):
            n = {t: sum(counts.get((lang, s, t), 0) for s in of) for t in kept}
            total = sum(n.values()) + smooth * len(kept)
            return {t: 1 + scale * (n[t] + smooth) // total for t in kept}

        p, q = {s: usage([s]) for s in sources}, usage(sources)
        for source in sources:
            pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in sources if o != source]
            terms = [(p[source][t] - q[t], t) for t in kept if counts.get((lang, source, t)) and p[source][t] > q[t]]
            for part, listed, most in (("pair", pairs, None), ("term", terms, top)):
                listed.sort(key=lambda e: (-e[0], e[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(listed[:most])]
    return sorted(out)


def repeated_words(words, window=8):
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + window)})
