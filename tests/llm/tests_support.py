"""Plain-Python versions that several tests compare with."""

import base64
import re


def roots(links, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_oracle(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    top = roots(links, range(len(rows)))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top[i]] = min(doc, least.get(top[i], doc))
    return sorted(
        ((doc, len(sets[i]), least.get(top[i]) if links and sets[i] else doc) for i, (doc, _) in enumerate(rows)),
        key=lambda r: tuple((x is None, x or 0) for x in r),
    )


def dedup_oracle(rows, least=50):
    """Delete every later place of a window of ``least`` words: {(id, text): (text, removed spans)}."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    # Rows that share an id come in the order of a hash; tests give them nothing in common.
    words = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for _, t in docs]
    first, gone = {}, {}
    places = [(tuple(docs[n][1][a:b] for a, b in w[i : i + least]), n, i) for n, w in enumerate(words) for i in range(len(w) - least + 1)]
    for key, n, i in places:
        first.setdefault(key, (n, i))
    for key, n, i in places:
        if first[key][0] != n or i >= first[key][1] + least:
            gone.setdefault(n, set()).update(range(i, i + least))
    out = {}
    for n, (doc, text) in enumerate(docs):
        off = sorted(gone.get(n, ()))
        spans = [[a, a] for a in off if a - 1 not in gone[n]]
        for s in spans:
            while s[1] in gone[n]:
                s[1] += 1
        at = [a for a, _ in words[n]] + [len(text)]
        kept, done = [], 0
        for a, b in spans:
            kept.append(text[done : at[a]])
            done = at[b]
        out[doc, text] = ("".join(kept) + text[done:], [tuple(s) for s in spans])
    return out


def tiktoken_encoding_of():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def thue_morse(length):
    """Two different words of ``a`` and ``b`` that sums of powers modulo 2**64 cannot tell apart."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
