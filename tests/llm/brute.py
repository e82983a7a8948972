"""Plain single-process versions of what the text operators compute."""

import hashlib
import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    """doc_id -> (keep_id, group_size, kept, sha256)."""
    groups = {}
    for i, t in docs:
        groups.setdefault(lower(t), []).append(i)
    return {i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), sha(lower(t))) for i, t in docs}


def substring(docs, window=20):
    """doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            g = tuple(words[s : s + window])
            if g in seen:
                gone[s : s + window] = [True] * window
            seen.add(g)
        kept = [w for w, x in zip(words, gone) if not x]
        out[i] = (len(words), len(words) - len(kept), sha(" ".join(kept)))
    return out


def simhash(text, shingle=4):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, bits=4, shingle=4):
    """doc_id -> (fingerprint, smallest doc_id reachable)."""
    fps = {i: simhash(t, shingle) for i, t in docs}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}
