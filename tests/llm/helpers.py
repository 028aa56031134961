"""Small corpora with the edge cases that every operator has to take: nulls, blanks, ties, copies, long texts, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, score double, spans string"
EMPTY = []


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), 1, 0.5, "x") for i, t in texts]


def corpus(seed=0, n=60):
    """Random prose over few words, with exact and near copies and shared passages."""
    rnd = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "Ñu", "re", "ta") for b in ("", "n", "st", "él", "o1")]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    docs = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 30, 80]))]
        if i % 7 == 0:
            body += passage.split()
        if i % 5 == 0 and docs:
            old = rnd.choice(docs)[1].split()
            if old and i % 10 == 0:
                old[rnd.randrange(len(old))] = "changed"
            body = old
        docs.append((i * 3, rnd.choice([" ", "\n", "  "]).join(body)))
    return [*docs, (1, None), (2, ""), (4, " \n\t "), (5, "word " * 3000), (7, "#!?"), (-8, passage)]
