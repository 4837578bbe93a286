"""A sparse ensemble of rules over text statistics, compiled into a column."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit reads at most: those of least hash.
TRAIN_ROWS = 20_000
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text that isn't null. Built-in functions only."""
    chars = F.char_length(text).cast("double")
    share = lambda n: n / F.greatest(chars, F.lit(1.0))
    without = lambda classes: chars - F.char_length(F.regexp_replace(text, classes, ""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("distinct")))
    of_lines = let(lines, lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("distinct")))
    return {
        "chars": chars,
        "word_stats": of_words,
        "line_stats": of_lines,
        "letters": share(without(r"\p{L}+")),
        "upper": share(without(r"\p{Lu}+")),
        "digits": share(without("[0-9]+")),
        "blanks": share(without(BLANK)),
        "marks": share(without(r"[.,;:'\"?!()-]+")),
        "bangs": share(without("!+")),
        "bars": share(without(r"[|]+")),
        "symbols": share(without(r"[#$%&*@^~=<>{}\[\]\\/_+`]+")),
    }


FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "letters", "upper", "digits", "blanks", "marks", "bangs", "bars", "symbols")


def with_features(docs: DataFrame) -> DataFrame:
    """`row`, a struct of all columns of docs, and `f`, a struct of FEATURES: no name of theirs can clash with one of docs.
    Each statistic is computed once in one expression, wherever the optimizer moves it."""

    def made(s: Column) -> Column:
        n, d, ln, ld = s["word_stats"]["n"], s["word_stats"]["distinct"], s["line_stats"]["n"], s["line_stats"]["distinct"]
        one = F.lit(1.0)
        own = {
            "log_chars": F.log1p(s["chars"]),
            "log_words": F.log1p(n),
            "word_length": s["chars"] / F.greatest(n, one),
            "distinct_words": d / F.greatest(n, one),
            "distinct_lines": ld / F.greatest(ln, one),
            "line_words": F.log1p(n / F.greatest(ln, one)),
        }
        return F.struct(*[own.get(k, s[k]).alias(k) for k in FEATURES])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return row.select("row", let(F.struct(*[c.alias(k) for k, c in statistics(text).items()]), made).alias("f"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def grow(x, y, rng, depth: int, least: int) -> list[tuple]:
    """A regression tree of random features and thresholds; returns every path from the root as a rule."""
    import numpy as np

    rules = []

    def split(rows, path):
        if len(path) == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        best = None
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, rng.uniform(0.02, 0.98, 12))):
                left = v <= t
                n = left.sum()
                if min(n, len(rows) - n) < least:
                    continue
                a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                gain = n * (len(rows) - n) / len(rows) * (a - b) ** 2
                if best is None or gain > best[0]:
                    best = (gain, int(f), float(t))
        if best:
            _, f, t = best
            for low in (True, False):
                side = (x[rows, f] <= t) == low
                rules.append((*path, (f, t, low)))
                split(rows[side], (*path, (f, t, low)))

    split(np.arange(len(y)), ())
    return rules


def fires(rule: tuple, x):
    import numpy as np

    out = np.ones(len(x), bool)
    for f, t, low in rule:
        out &= (x[:, f] <= t) == low
    return out


def fit(x, y, trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 600, seed: int = 11) -> dict:
    """Rules from small trees on halves of the rows, then lasso logistic weights by proximal gradient; rules of weight 0 go."""
    import numpy as np

    rng = np.random.default_rng(seed)
    prior = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    model = {"rules": [], "weights": [], "bias": math.log(prior / (1 - prior))}
    if len(y) < 20 or y.min() == y.max():
        return model
    rules = []
    for _ in range(trees):
        part = rng.choice(len(y), max(20, min(len(y) // 2, 4000)), replace=False)
        rules += grow(x[part], y[part], rng, int(rng.integers(1, depth + 1)), max(5, len(part) // 100))
    # A column of bits for each rule; of rules that fire alike the first stays, those that always or never fire go.
    kept: dict[bytes, tuple] = {}
    for rule in dict.fromkeys(rules):
        on = fires(rule, x)
        if 0 < on.sum() < len(y):
            kept.setdefault(np.packbits(on).tobytes(), rule)
    if not kept:
        return model
    rules = list(kept.values())
    a = np.empty((len(y), len(rules)), np.float32)
    for i, bits in enumerate(kept):
        a[:, i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(y))
    del kept
    # Columns are centred and scaled where they are multiplied, not in copies.
    mean = a.mean(0, dtype=np.float64)
    scale = np.sqrt(mean * (1 - mean))
    times = lambda v: (a @ (v / scale).astype(np.float32)).astype(np.float64) - float(mean @ (v / scale))
    turned = lambda v: ((a.T @ v.astype(np.float32)).astype(np.float64) - mean * v.sum()) / scale
    gram = ((a.T @ a).astype(np.float64) / len(y) - np.outer(mean, mean)) / np.outer(scale, scale)
    w, z, b, t = np.zeros(len(rules)), np.zeros(len(rules)), model["bias"], 1.0
    step = 4 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(z) + b, -30, 30)))
        new = z - step * turned(p - y) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= float((p - y).mean())
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    on = np.nonzero(np.abs(w) > 1e-6)[0]
    raw = w[on] / scale[on]
    return {"rules": [rules[i] for i in on], "weights": [float(v) for v in raw], "bias": float(b - raw @ mean[on])}


def compiled(model: dict, f: Column) -> Column:
    """The model as one column over the features f: the logistic of the sum of weights of the rules that hold."""
    total = F.lit(model["bias"])
    for rule, weight in zip(model["rules"], model["weights"], strict=True):
        holds = None
        for i, t, low in rule:
            c = f[FEATURES[i]]
            c = c <= F.lit(t) if low else c > F.lit(t)
            holds = c if holds is None else holds & c
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Learns labels.quality from the labelled rows that held_out leaves: at most `rows` labels, those of least hash of
    the id, and of the documents that have them at most `rows`, ordered likewise; of equal hashes those of smaller id,
    statistics and label. Labels, language, source and id are no features. Rows without a label or id don't count; a
    document with several labels counts with each, a repeated one each time. With none, or one class, the model is a
    constant."""
    import numpy as np

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("of"), F.col("quality").alias("y"))
    known = known.orderBy(F.xxhash64("of"), "of", "y").limit(rows)
    # At most `rows` ids of 8 bytes: bounded by the parameter.
    got = with_features(docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of")))
    got = got.select(F.col("row.doc_id").alias("doc_id"), F.col("row.y").alias("y"), *[F.col(f"f.{k}").alias(k) for k in FEATURES])
    frame = got.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "y").limit(rows).toPandas()
    return fit(frame[list(FEATURES)].to_numpy(float).reshape(len(frame), len(FEATURES)), (frame["y"] >= 1).to_numpy(float))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1, every row; null and empty texts too, and very long ones whole). Other columns stay
    whatever their names, an own `score` is replaced; repeated rows and ties are scored alike; without rows there are none."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "score"]
    return with_features(docs).select(*kept, let(F.col("f"), lambda f: compiled(model, f)).alias("score"))
