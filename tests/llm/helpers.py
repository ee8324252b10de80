import os
import random
import re

SMALL = "/root/testdata/sf0.001"
TINY_TEXTS = [None, "", " \n\t ", "one", "Two words", "a b c", "ÄÖ ü x é", "x" * 3000, "same words here " * 40, "same words here " * 40]


def table(spark, name, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, n=120):
    return [r[0] for r in table(spark, "documents").orderBy("doc_id").limit(n).select("text").collect()]


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, extra=""):
    """Documents of (doc_id, text), with columns of names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "k") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n int, key string")


def near_family(seed, base, n, most):
    """Copies of a list of words with up to ``most`` of them replaced."""
    r, found = random.Random(seed), []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, most)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(10 ** 6)}"
        found.append(" ".join(copy))
    return found


def path(name):
    import public_tokenizers
    return public_tokenizers.path(name)


assert os.path.isdir(SMALL)
