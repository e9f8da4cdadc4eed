"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, n=3):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """For each value the set of positions in its class."""
    left, out = set(range(len(values))), [None] * len(values)
    while left:
        todo, found = [left.pop()], set()
        while todo:
            i = todo.pop()
            found.add(i)
            near = {j for j in left if linked(values[i], values[j])}
            left -= near
            todo += near
        for i in found:
            out[i] = found
    return out


def near_classes(prints, bits=2):
    return classes(prints, lambda a, b: (a ^ b).bit_count() <= bits)


def removed_runs(texts, least):
    """(bytes, runs of bytes that a repeated string of ``least`` bytes covers) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + least] for b in data for p in range(len(b) - least + 1))
    out = []
    for b in data:
        runs = []
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + least
                else:
                    runs.append([p, p + least])
        out.append((b, [tuple(r) for r in runs]))
    return out


def without(data, runs):
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def measures(text):
    text = text or ""
    w = words(text)
    fives = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(fives)
    again = {i + k for i, f in enumerate(fives) if count[f] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "n_lines": len(lines),
        "n_doubled": sum(a == b for a, b in zip(w, w[1:])),
    }


def base_failed(m):
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def good(text):
    m = measures(text)
    return not (
        base_failed(m)
        or 100 * m["n_symbols"] > 10 * m["n_words"]
        or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
        or 100 * m["n_doubled"] > 30 * m["n_words"]
        or m["word_chars"] < 2 * m["n_words"]
        or m["word_chars"] > 15 * m["n_words"]
    )


def chunked(text):
    """Chunks (lists of lines) of a text."""
    lines = text.split("\n")
    worded = [n for n, line in enumerate(lines) if WORD.search(line)]
    marks, before = [], ""
    for n in worded:
        own = hashlib.md5(lines[n].encode()).hexdigest()
        marks.append(hashlib.md5((before + own).encode()).hexdigest()[0] in "01234567")
        before = own
    out, start = [], 0
    for k in range(1, len(worded) - 2):
        if marks[k] and not marks[k - 1]:
            out.append(lines[start : worded[k] + 1])
            start = worded[k] + 1
    return [*out, lines[start:]]


def line_dedup(rows):
    """(doc_id, text) rows with their texts after removal; all rows must differ."""
    order = sorted((d is None, d or 0, n) for n, (d, _) in enumerate(rows))
    seen, out = set(), [None] * len(rows)
    for _, _, n in order:
        text = rows[n][1]
        if text is None:
            continue
        kept = []
        for chunk in chunked(text):
            body = "\n".join(chunk)
            if sum(1 for line in chunk if WORD.search(line)) >= 2:
                if body in seen:
                    continue
                seen.add(body)
            kept += chunk
        out[n] = (kept, text)
    return ["\n".join(x[0]) if x else None for x in out]


def leak_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(docs, items, window=20, percent=80, least=8):
    """(document number, item number) pairs, without seeds: windows are compared at every shift with equal words."""
    sides = [leak_words(t) for t in items]
    places = defaultdict(list)
    for k, words in enumerate(sides):
        for q, word in enumerate(words if len(words) >= least else []):
            places[word].append((k, q))
    found = set()
    for d, text in enumerate(docs):
        words = leak_words(text)
        same = defaultdict(list)
        for p, word in enumerate(words if len(words) >= least else []):
            for k, q in places.get(word, ()):
                same[k, p - q].append(q)
        for (k, shift), equal in same.items():
            width = min(window, len(words), len(sides[k]))
            if 100 * len(equal) < percent * width:
                continue
            first, last = max(0, -shift), min(len(sides[k]), len(words) - shift) - width
            if any(100 * sum(q <= x < q + width for x in equal) >= percent * width for q in range(first, last + 1)):
                found.add((d, k))
    return found

