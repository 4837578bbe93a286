"""Personal data: fixed patterns, and contexts bootstrapped from what they find."""

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch as S

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token that may be an identifier has a digit or an at sign; white space and bars end it.
MARK, DIGIT, EDGE = re.compile("[0-9@]"), re.compile("[0-9]"), re.compile(r"[\s|]")
#: What single blanks may join to one identifier: digits with brackets, dashes and the like.
PART = re.compile(r"[0-9()\[\]+./\u2013\u2014-]+[,;:!?\"']*(?=[\s|]|\Z)")
ADDRESS = re.compile(r"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}")
HEAD, TAIL, BRACKETS = "\"'.,;: -\u2013\u2014", "\"'.,;:!? -\u2013\u2014", {"(": ")", "[": "]"}
#: No identifier of these kinds has more digits, or is longer.
MOST_DIGITS, LONGEST = 19, 320
WORD = re.compile(r"[^\W\d_]+")
#: A label right before an identifier.
LABEL = re.compile(r"([^\W\d_]+)[ \t]*([:=#])[\s\"'(\[]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of LOCAL@DOMAIN, from each at sign outwards: no word without one is tried."""
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] < "\x7f" and (text[low - 1].isalnum() or text[low - 1] in "._%+-"):
            low -= 1
        if low < at and (m := DOMAIN.match(text, at + 1)):
            yield low, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns by start, then kind as listed. A match that fails its test is dropped, not retried."""
    if not text:
        return []
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def fits(token: str) -> list[str]:
    """The kinds a token could be of, whatever its exact format: by its characters and number of digits only."""
    digits, letters = len(DIGIT.findall(token)), WORD.search(token) is not None
    may = {"email": letters and "@" in token, "ip": digits > 0 and ADDRESS.fullmatch(token) is not None}
    may |= {"card": not letters and 12 <= digits <= MOST_DIGITS, "phone": not letters and 6 <= digits <= 15}
    return [k for k in KINDS if may[k]]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, from the 40 code points on each side on its line, ^ and $ being the line's ends:
    the word on either side; the two words on the left; the two on the right; and a word with a colon, an equals or a
    number sign right before the span. A side without a word and without the line's end in reach gives no pattern."""
    before, after = text[max(0, start - 40) : start].rpartition("\n"), text[end : end + 40].partition("\n")
    left, right = WORD.findall(before[2].lower()), WORD.findall(after[0].lower())
    left = (["^"] if before[1] or start <= 40 else []) + left
    right = right + (["$"] if after[1] or end + 40 >= len(text) else [])
    out = []
    if left and right and (left[-1] != "^" or right[0] != "$"):
        out.append(f"{left[-1]} _ {right[0]}")
    if len(left) > 1:
        out.append(f"{left[-2]} {left[-1]} _")
    if len(right) > 1:
        out.append(f"_ {right[0]} {right[1]}")
    if m := LABEL.search(before[2]):
        out.append(f"{m[1].lower()}{m[2]} _")
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without punctuation around it, and without brackets that enclose all of it or have no partner in it."""
    while a < b:
        if text[b - 1] in TAIL:
            b -= 1
        elif text[a] in HEAD:
            a += 1
        elif text[a] in BRACKETS:
            close = text.find(BRACKETS[text[a]], a, b)
            if 0 <= close < b - 1:
                break
            a, b = a + 1, b - (close >= 0)
        elif any(text[b - 1] == y and text.count(x, a, b) < text.count(y, a, b) for x, y in BRACKETS.items()):
            b -= 1
        else:
            break
    return a, b


def candidates(text: str, free):
    """(start, end) of what may be identifiers where free(start, end): tokens, and numeric tokens that single blanks
    join, unless together they have too many digits for one."""
    b = 0
    while m := MARK.search(text, b):
        a = m.start()
        while a > b and not EDGE.match(text[a - 1]):
            a -= 1
        end = EDGE.search(text, m.start())
        b = end.start() if end else len(text)
        if not free(a, b):
            continue
        parts, digits = [(a, b)], len(DIGIT.findall(text, a, b))
        more = PART.match(text, a)
        while more and more.end() == b and text[b - 1] not in ".,;:!?\"'" and text[b : b + 1] == " " and digits <= MOST_DIGITS:
            more = PART.match(text, b + 1)
            if more and free(*more.span()):
                parts.append(more.span())
                digits += len(DIGIT.findall(text, *more.span()))
                b = more.end()
        whole = trimmed(text, a, b) if b - a <= LONGEST else (a, a)
        if digits <= MOST_DIGITS and fits(text[slice(*whole)]):
            yield whole
        elif len(parts) > 1:
            yield from (trimmed(text, *p) for p in parts if p[1] - p[0] <= LONGEST)


def mentions(text: str | None):
    """(patterns, instance, kinds it could be of, kind or None, start, end) of identifiers; kind where a fixed pattern finds it."""
    spans = base_spans(text)
    covers: list[tuple[int, int, set]] = []  # spans that overlap, together
    for a, b, kind in spans:
        if covers and a < covers[-1][1]:
            covers[-1] = (covers[-1][0], max(covers[-1][1], b), covers[-1][2] | {kind})
        else:
            covers.append((a, b, {kind}))
    starts = [c[0] for c in covers]
    for a, b, kind in spans:
        if p := contexts(text, a, b):
            found = covers[bisect_right(starts, a) - 1][2]
            yield p, text[a:b], [k for k in KINDS if k == kind or k not in found and k in fits(text[a:b])], kind, a, b

    def free(a, b):
        i = bisect_left(starts, b) - 1
        return i < 0 or covers[i][1] <= a

    for a, b in candidates(text or "", free):
        if (kinds := fits(text[a:b])) and (p := contexts(text, a, b)):
            yield p, text[a:b], kinds, None, a, b


def learn(docs: DataFrame, rounds: int = 4, support: int = 3, confidence: float = 0.8, hide: int = 0) -> DataFrame:
    """Patterns (kind, pattern, confidence) of high confidence, from a graph of patterns and instances over all of docs.

    Instances found by the fixed patterns are seeds of score 1, others that fit a kind start at 0. A pattern's confidence
    for a kind is the sum of the scores of its distinct instances that fit it, divided by their number plus 1; it counts
    if it is `confidence` or more and at least `support` of these instances are accepted, that is seeds or found by a
    pattern that counts. An instance that isn't a seed takes the best confidence of its patterns that count. So what a
    pattern finds supports further patterns: a second generation finds what no pattern of the first did. There are
    `rounds` passes after the first, none if nothing counts. Edges are summed where they are read; each pass ends in a table in the
    shared folder. Null and empty texts have no mentions; without rows the result is empty; a long text is read whole,
    and repeated rows count once.

    hide: if not 0, seeds whose crc32 is a multiple of it play no part, so that what the patterns find of them again
    measures recall.
    """
    spark = docs.sparkSession
    here = S.scratch(spark, "pii")

    def edges(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            got = set()
            for text in batch.column(0):
                for patterns, i, kinds, seed, *_ in mentions(text.as_py()):
                    if not (hide and seed and zlib.crc32(i.encode("utf-8", "surrogatepass")) % hide == 0):
                        got.update((p, i, kind, kind == seed) for p in patterns for kind in kinds)
            types = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], t) for j, t in enumerate(types)], ["pattern", "instance", "kind", "seed"])

    graph = docs.select("text").mapInArrow(edges, "pattern string, instance string, kind string, seed boolean")
    graph = S.saved(graph.groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed")), f"{here}/edges")
    # A pattern with fewer instances than `support` can never count: only the others' edges carry a score. Its number of
    # instances rides along.
    enough = graph.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= support)
    graph = S.saved(graph.join(enough, ["pattern", "kind"]), f"{here}/graph")
    # All but few instances that aren't seeds stay at 0; the table of scores holds the others only.
    scores = S.saved(graph.where("seed").select("instance", "kind", F.lit(1.0).alias("score")).distinct(), f"{here}/scores0")
    i = 0
    while True:
        sums = graph.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("accepted"), F.max("all").alias("all"))
        rated = sums.withColumn("confidence", F.col("sum") / (F.col("all") + 1)).where((F.col("accepted") >= support) & (F.col("confidence") >= confidence))
        patterns = S.saved(rated.select("kind", "pattern", "confidence"), f"{here}/patterns{i}")
        if i == rounds or patterns.isEmpty():
            return patterns
        i += 1
        found = graph.where("not seed").join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        seeds = graph.where("seed").select("instance", "kind", F.lit(1.0).alias("score"))
        scores = S.saved(found.unionByName(seeds).groupBy("instance", "kind").agg(F.max("score").alias("score")), f"{here}/scores{i}")


#: Patterns up to this many travel to each worker as one lookup table; beyond, mentions are joined to them.
LOOKUP = 200_000


def extract(docs: DataFrame, patterns: DataFrame, lookup: int = LOOKUP) -> DataFrame:
    """docs (doc_id, text) with base, spans: arrays of (start, end, kind) in code points; spans holds all of base
    and what the learned patterns add. Null and empty texts have none; repeated rows stay."""
    known = patterns.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("less"), "kind"))).alias("kinds"))
    spark = docs.sparkSession
    rows = known.limit(lookup + 1).collect()
    table = {r["pattern"]: [tuple(k) for k in r["kinds"]] for r in rows}
    kept = [f for f in docs.schema.fields if f.name not in ("base", "spans")]
    span = "array<struct<start:int,end:int,kind:string>>"
    here = S.scratch(spark, "pii-patterns")
    if len(rows) > lookup:  # one file per hash of the pattern, read as needed
        table = None
        files = 256

        def write(key, pdf):
            import pickle

            S.put(f"{here}/{int(key[0])}.pkl", pickle.dumps({p: [(x["less"], x["kind"]) for x in k] for p, k in zip(pdf["pattern"], pdf["kinds"], strict=True)}))
            return pdf.iloc[:1][["pattern"]]

        known.groupBy(F.pmod(F.crc32(F.col("pattern").cast("binary")), F.lit(files))).applyInPandas(write, "pattern string").collect()

    def find(batches):
        import pickle
        import zlib
        from functools import lru_cache

        import pyarrow as pa

        @lru_cache(16)
        def part(i):
            try:
                return pickle.loads(S.get(f"{here}/{i}.pkl"))
            except FileNotFoundError:
                return {}

        def kind_of(patterns, kinds):
            """The kind of the most confident pattern that has one of kinds."""
            known = [c for p in patterns for c in (table if table is not None else part(zlib.crc32(p.encode()) % 256)).get(p, ()) if c[1] in kinds]
            return min(known, default=(0, None))[1]

        names = [f.name for f in kept]
        for batch in batches:
            bases, alls = [], []
            for text in batch.column(names.index("text")):
                text = text.as_py()
                base = base_spans(text)
                more = []
                if table or table is None:
                    more = [(a, b, k) for p, _, kinds, seed, a, b in mentions(text) if seed is None and (k := kind_of(p, kinds))]
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                alls.append([{"start": a, "end": b, "kind": k} for a, b, k in sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases, kind), pa.array(alls, kind)], [*names, "base", "spans"])

    from pyspark.sql.types import DataType, StructType

    schema = StructType(kept + DataType.fromDDL(f"base {span}, spans {span}").fields)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(find, schema)
