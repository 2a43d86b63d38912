"""Small fixtures: rows that every operator must bear."""

import random
import re

DOC = "doc_id bigint, text string, lang string, source string, id string, kept string, label int"


def docs(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names operators use inside."""
    full = [(*r, *(None,) * (4 - len(r)), "x", None, 7) for r in rows]
    return spark.createDataFrame(full, DOC)


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def vocabulary(n):
    return [f"w{i}" for i in range(n)]


def words(text):
    """The words of the contract: A-Z folded, parted by six kinds of blanks."""
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near_components(rows):
    """{doc_id: smallest doc_id reachable} by comparing all pairs, for (doc_id, text) with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus(rng, n=120):
    """(doc_id, text): clean texts, copies, near copies of all grades, chains, shared passages, odd ones."""
    vocab = vocabulary(400)
    passage = sentence(rng, 60, vocab)
    texts = [sentence(rng, rng.randint(1, 120), vocab) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    texts += [f"{sentence(rng, 30, vocab)} {passage}" for _ in range(12)]
    chain = sentence(rng, 80, vocab).split(" ")
    for k in range(12):
        chain = chain[2:] + [f"c{k}", f"d{k}"]
        texts.append(" ".join(chain))
    texts += [None, "", "  \n ", "one", "ONE", "one two", "É é", "é É", "a\x0bb\x0cc", "a b c", None]
    return list(enumerate(texts))
