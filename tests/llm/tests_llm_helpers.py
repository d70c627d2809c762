"""Brute-force versions that more than one test uses."""

from parcela.llm import order_minhash as o


def all_pairs_classes(texts):
    """The smallest key of the class of each text, from all pairs."""
    words = {k: o.words([t])[0] for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if o.similarity(words[a], words[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}
