import random

WORDS = "the of and to in is was for on that by this with from harbour lantern quiet orchard meadow copper winter engine river signal".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "sur", "ba", "dru", "el"]) for _ in range(r.randint(1, 4))) if r.random() < 0.6 else r.choice(WORDS) for _ in range(n))


#: doc_id, text, lang, source and columns whose names clash with inner ones.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, f0 string, key string, bucket string, kind string, data string, label string, size string"


def rows():
    base = prose(1, 300)
    texts = [base, base, base.replace("the", "teh", 1), prose(2, 40), "", None, " \t\n", "one", "two words", prose(3, 9000), "Ünïcödé ß 日本語 😀 " * 20, prose(1, 299) + " x", "aaaa" * 100, "a b a b " * 60, "\x1c\x0b odd\x85white space", prose(5, 120), prose(5, 120)]
    out = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "Z"][i % 4]) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, prose(6, 50), "en", "a"), (None, None, None, None), (4, prose(7, 60), "fr", "b")]
    return [(*r, len(r[1] or ""), *"stuvwxyz") for r in out]


def find_components(vertices, pairs):
    """Vertex -> least vertex of its component."""
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}
