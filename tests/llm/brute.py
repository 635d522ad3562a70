"""Plain versions of operators, for small inputs."""

import hashlib
from collections import Counter, defaultdict


def repeats(texts, window=200):
    """Per text: (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def components(sets, percent=80):
    """Smallest index linked to each, over any chain; sets are compared pair by pair."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(sets))]


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return out


def phrase_places(words, phrases):
    """{label: starts} of phrases, word by word."""
    found = defaultdict(list)
    for text, label in phrases:
        p = text.split()
        found[label] += [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return {k: v for k, v in found.items() if v}


def root(label, i):
    while label[i] != i:
        i = label[i]
    return i
