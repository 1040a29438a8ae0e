import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _id string"


def texts(seed=0, n=60):
    """Short documents with copies, near copies, nulls, empties, repeated words and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    made = []
    while len(made) < n:
        k = rng.random()
        if k < 0.1:
            made.append(rng.choice([None, "", " \n\t ", "a", "A a\x0ba", "中文 　x\x1c", "!!! ###"]))
        elif k < 0.6 and any(made):
            base = rng.choice([m for m in made if m]).split(" ")
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.2:
                base.insert(rng.randrange(len(base)), rng.choice(words))
            made.append(" ".join(base))
        else:
            made.append(" ".join(rng.choice(words).capitalize() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.choice([2, 5, 9, 12, 18, 25, 40, 120]))))
    made.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return made


def rows(seed=0, n=60):
    found = [(i * 3 % 1009, t, ["en", "fr", None][i % 3], None if i % 7 == 0 else "s", None, i, "x") for i, t in enumerate(texts(seed, n))]
    return found + [(None, found[0][1] or "b c", "en", "s", 1, 1, None), found[5], found[5]]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)
