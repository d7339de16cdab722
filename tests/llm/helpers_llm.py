"""Edge rows and brute-force versions for the tests of this folder."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np

TEXTS = [None, "", "   \n", "word", "a b c", "a b c d", "A b  C d e", "x" * 5000, "long text " * 3000, "naïve café 中文 😀 ünï", "same text here again and again", "same text here again and again", "tab\tand\x0bothers\x1c  end ", "1 2 3 4 5 6 !!! ??? ---", "<|endoftext|> \x00 \x01", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|> ,c", "x <|endoftext| > y"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, node long, label int, row long, digest string, signature string, size long, weight double, key string, shard int"


def edge_docs(spark, empty: bool = False):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that the operators use themselves."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if i % 5 == 0 else len(t or ""), 0.5, "x", 1, 1, 2, "d", "g", 3, 1.0, "k", 0) for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[3], (None, "no id here", None, None, None, *[None] * 11), (3, "another text of the same id", "en", "s1", 5, *[None] * 11)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


@cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_brute(texts, size, percent):
    """For each text: the smallest linked index reachable, and the number of links."""
    sets = [shingles(t, size) for t in texts]
    up, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            where[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], links, [len(s) for s in sets]


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
