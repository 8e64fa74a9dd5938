"""Plain definitions of the results, for small tables: rows are (doc_id, text) pairs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha256(b):
    return hashlib.sha256(b).hexdigest()


def simhash(rows):
    prints = []
    for _, text in rows:
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    a = np.array(prints, dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            root[find(int(j))] = find(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {(d, f"{prints[i]:016x}", min(least[find(i)])) for i, (d, _) in enumerate(rows)}


def warc(rows):
    first = {}
    for i, html in rows:
        first[html or ""] = max(first.get(html or "", i), i)
    out = set()
    for i, html in rows:
        raw = (html or "").encode()
        later = len(raw) >= 1000 and first[html or ""] != i
        out.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if later else "response", first[html or ""] if later else None))
    return out


def exact(rows):
    groups = defaultdict(list)
    for d, text in rows:
        groups[text or ""].append(d)
    return {(d, max(g := groups[text or ""]), len(g), d == max(g), sha256((text or "").encode())) for d, text in rows}


def base_counts(rows):
    out = set()
    for d, text in rows:
        text = text or ""
        words = [w.decode() for w in WORD.findall(text.encode())]
        lines = [x for x in text.split("\n") if WORD.search(x.encode())]
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for k in range(3)}
        n = len(words)
        out.add((d, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n))
    return out


def substrings(rows, window=20):
    seen, out = {}, set()
    texts = {d: WORD.findall((t or "").encode()) for d, t in rows}
    for d in sorted(texts):
        words, gone = texts[d], set()
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (d, i)) != (d, i):
                gone.update(range(i, i + window))
        out.add((d, len(words), len(gone), sha256(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def suffixes(rows, window=400):
    raws = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(hash(r[i : i + window]) for _, r in raws for i in range(len(r) - window + 1))
    n = Counter(r[i : i + window] for _, r in raws for i in range(len(r) - window + 1) if n[hash(r[i : i + window])] > 1)
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - window + 1):
            if n[r[i : i + window]] > 1:
                gone[i : i + window] = True
        left = np.frombuffer(r, dtype=np.uint8)[~gone[:-1]].tobytes()
        out.append((d, len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), sha256(left)))
    return out


def url(text, rules):
    host = path = ""
    if text is not None and "://" in text:
        host, path = re.match(r"[^/?#]*", (rest := text.split("://", 1)[1]))[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in rules if host and (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def check_packing(pieces, ids_of, size=1024):
    """pieces: (doc_id, piece, start, length, crc, sequence, offset)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append((p[6], p[3]))
    for d, ids in ids_of.items():
        at = 0
        for k, p in enumerate(sorted(by_doc[d], key=lambda p: p[1])):
            assert (p[1], p[2]) == (k, at)
            assert p[3] == size or k == 0
            assert p[4] == zlib.crc32(np.array(ids[at : at + p[3]], dtype="<u4").tobytes())
            at += p[3]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)
