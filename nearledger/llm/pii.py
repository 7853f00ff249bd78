"""PII: generators propose spans, boosted trees score them, calibrated thresholds select redactions. DataFrame and SQL functions only.

Generators are regular expressions that run in time linear in the text: runs are entered at their start only and never
backtracked into. Places come from the gaps that splitting by the same expression leaves, summed up per text. The base kinds
(email, ip, card, phone) are decided by their own rules and always stay. Looser generators propose further spans, which may overlap them; a gradient-boosted
model over format and context features, turned into one SQL expression, scores these, and those above their kind's
threshold that no base span overlaps join the redactions. The model is fitted on the driver, in a second, to a fixed
set of made-up examples; half of them set the thresholds.

Edge cases: null and empty texts have no spans; a null doc_id stays null; repeated rows each get a row; places count code points; texts without a
single candidate leave the scan as a row without spans; an empty table gives no rows; other columns are ignored by find_pii and kept by redact.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Base generators, in the order of their listing. \G lets a match begin where the one before ended, inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose generators: name, expression.
LOOSE = {
    "numbers": r"(?<![0-9])(?:\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{13,19})(?![0-9])",
    "strings": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|[A-Za-z0-9._-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]{1,64})+|[0-9A-Za-z_-]{24,128}(?![0-9A-Za-z_-]))",
}
#: Kinds of loose spans and how their texts look, in the order of their listing after the base kinds; the first that fits.
KINDS = {
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "local_phone": r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$",
    "account": r"^[0-9]{13,19}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$",
    "written_email": r"[\[(]at[\])]",
    "secret": r"^[0-9A-Za-z_-]+$",
}
ORDER = [*BASE, *KINDS]
#: Characters of context on either side.
CONTEXT = 40
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

#: Precision that a threshold must reach on the examples that set it.
PRECISION = 0.98
WORDS = {
    "says_phone": r"(?i)(?:phone|tel|call|mobile|fax|fon|cell)\W*\w{0,12}\W*$",
    "says_id": r"(?i)(?:ssn|social security|tax id|security number)\W*\w{0,8}\W*$",
    "says_bank": r"(?i)(?:iban|account|konto|bank|card|credit|visa|mastercard|acct)\W*\w{0,12}\W*$",
    "says_secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)[\"']?\s*(?:=|:|is)\s*[\"']?$",
    "says_other": r"(?i)(?:order|part|isbn|version|lot|serial|build|commit|id|no|item|page|ref|sha|hash)\W*$",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\.", -1), lambda p: p.rlike(OCTET))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), F.call_function("luhn_check", _digits(x))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, row_hash and found: per generator its matches (generator, i, match, gap before it, context). To be written before use: row ids hold for one run."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.coalesce("text", F.lit("")).alias("t"))
    # what a text lacks altogether is not searched for
    needs = {"email": F.contains("t", F.lit("@")), "phone": F.contains("t", F.lit("+")), "strings": F.lit(True)}
    none = F.expr("cast(array() as array<string>)")
    generators = BASE | LOOSE
    digit = rows.withColumn("has_digit", F.col("t").rlike("[0-9]"))
    split = digit.select(
        "rid", "doc_id", "row_hash",
        *[F.when(needs.get(g, F.col("has_digit")), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{g}") for g, p in generators.items()],
        *[F.when(needs.get(g, F.col("has_digit")), F.split("t", p, -1)).otherwise(none).alias(f"g_{g}") for g, p in generators.items()],
    )
    zipped = split.select("rid", "doc_id", "row_hash", *[F.arrays_zip(F.col(f"m_{g}"), F.slice(f"g_{g}", 1, F.size(f"m_{g}")), F.slice(f"g_{g}", 2, F.size(f"m_{g}"))).alias(g) for g in generators])

    def spans(g: str) -> Column:
        side = lambda x, k: F.coalesce(x[k], F.lit(""))
        return F.transform(g, lambda x, i: F.struct(F.lit(g).alias("generator"), i.alias("i"), x[f"m_{g}"].alias("match"), F.length(x["1"]).alias("gap"), F.right(side(x, "1"), F.lit(CONTEXT)).alias("left"), F.left(side(x, "2"), F.lit(CONTEXT)).alias("right")))

    found = [spans(g) for g in generators]
    return zipped.select("rid", "doc_id", "row_hash", F.concat(*found).alias("found"))


def _features() -> dict[str, Column]:
    """Format and context features of a span, from the columns match, left and right."""
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    number = lambda c: c.cast("int")
    chars = F.regexp_extract_all(m, F.lit("(?s)."), F.lit(0))
    kind = F.coalesce(*[F.when(m.rlike(p), F.lit(k)) for k, p in KINDS.items()])
    return {
        **{f"is_{k}": number(kind == k) for k in KINDS},
        "n_chars": F.length(m),
        "n_digits": F.length(_digits(m)),
        "n_upper": F.length(F.regexp_replace(m, "[^A-Z]", "")),
        "n_signs": F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")),
        "distinct": F.size(F.array_distinct(chars)),
        "turns": F.size(F.regexp_extract_all(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))),
        "is_hex": number(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "luhn": number(_valid("card", m)),
        "quoted": number(left.rlike("[\"'(<]$") & right.rlike("^[\"')>]")),
        "joined": number(left.rlike("[0-9A-Za-z_/.-]$") | right.rlike("^[0-9A-Za-z_/-]")),
        **{k: number(left.rlike(p)) for k, p in WORDS.items()},
    }


def examples(seed: int = 5, each: int = 150) -> list[tuple[str, str, str, int]]:
    """Made-up spans with their contexts and labels; the same for every run."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = lambda n, of: "".join(r.choice(of) for _ in range(n))
    plain = ["we saw the ", "and then of ", "in the course of ", "near ", "about ", ""]
    after = [" and more.", ".", ", then", " was", '"', ""]
    other = ["order ", "part no. ", "isbn ", "version ", "lot ", "serial ", "build ", "ref ", "commit ", "page ", "item "]
    out = []

    def add(match, lefts, label):
        out.append((match, r.choice(plain) + r.choice(lefts), r.choice(after), label))

    for _ in range(each):
        ssn = f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        add(ssn, ["SSN ", "ssn: ", "social security number ", "tax id "], 1)
        add(ssn, [*other, *plain], 0)
        tel = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"])
        add(tel, ["phone ", "tel. ", "call ", "mobile: ", "fax ", "call me at "], 1)
        add(tel, [*other, *plain], 0)
        number = d(r.randint(13, 19))
        add(number, ["account ", "bank account: ", "card ", "credit card no ", "konto "], 1)
        add(number, [*other, *plain], 0)
        iban = r.choice(["DE", "FR", "GB", "ES", "NL"]) + d(2) + r.choice(["", " "]).join(["", *[pick(4, "0123456789") for _ in range(4)]]) + r.choice(["", d(2)])
        add(iban, ["IBAN ", "iban: ", "account ", *plain], 1)
        add(pick(2, "ABCDEFGH") + d(2) + pick(r.choice([12, 16]), "ABCDEFGHKLMNPQRSTUVWXYZ"), [*other, *plain], 0)
        name = pick(r.randint(3, 8), "abcdefghijklmnop")
        add(f"{name}{r.choice(['[at]', ' [at] ', '(at)', ' (at) '])}{pick(6, 'abcdef')}{r.choice(['.', ' [dot] ', '(dot)'])}com", ["write to ", "mail ", *plain], 1)
        secret = r.choice([pick(40, "0123456789abcdef"), pick(32, "0123456789abcdef"), pick(36, "ABCDEFGHabcdefgh0123456789xyzXYZ"), pick(28, "ABCDEFGHIJabcdefghij0123456789")])
        add(secret, ['token = "', "secret: ", "api_key=", "password = '", 'access_key: "', "key = "], 1)
        add(secret, [*other, "sha ", "hash ", "git/", *plain], 0)
        add(pick(r.randint(24, 40), "abcdefghijklmnopqrstuvwxyz"), ["key: ", *plain], 0)
        add(pick(1, "aeiou-_0") * r.randint(24, 60), ["token = ", *plain], 0)
    r.shuffle(out)
    return out


class Boosted:
    """Gradient-boosted trees of depth two for the logistic loss, in plain Python; small inputs only."""

    def __init__(self, rows: list[list[int]], labels: list[int], rounds: int = 40, rate: float = 0.4):
        self.base, self.trees = 0.0, []
        score = [0.0] * len(rows)
        cuts = [sorted({r[k] for r in rows}) for k in range(len(rows[0]))]
        cuts = [c[1 :: max(1, len(c) // 12)] for c in cuts]
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-s)) for s in score]
            g, h = [y - q for y, q in zip(labels, p, strict=True)], [q * (1 - q) for q in p]
            tree = self.grow(rows, g, h, list(range(len(rows))), cuts, 2, rate)
            self.trees.append(tree)
            score = [s + self.leaf(tree, r) for s, r in zip(score, rows, strict=True)]

    @classmethod
    def grow(cls, rows, g, h, at, cuts, depth, rate):
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        best = None
        if depth:
            for k, own in enumerate(cuts):
                by: dict[int, list[float]] = {}
                for i in at:
                    x = by.setdefault(rows[i][k], [0.0, 0.0])
                    x[0] += g[i]
                    x[1] += h[i]
                for c in own:
                    a = sum(x[0] for v, x in by.items() if v < c)
                    b = sum(x[1] for v, x in by.items() if v < c)
                    gain = a * a / (b + 1) + (sg - a) ** 2 / (sh - b + 1) - sg * sg / (sh + 1)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = gain, k, c
        if best is None:
            return round(rate * sg / (sh + 1), 6)
        _, k, c = best
        low, high = [i for i in at if rows[i][k] < c], [i for i in at if rows[i][k] >= c]
        return k, c, cls.grow(rows, g, h, low, cuts, depth - 1, rate), cls.grow(rows, g, h, high, cuts, depth - 1, rate)

    @classmethod
    def leaf(cls, tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return sum(self.leaf(t, row) for t in self.trees)

    def sql(self, names: list[str]) -> Column:
        def text(tree) -> str:
            return f"CASE WHEN {names[tree[0]]} < {tree[1]} THEN {text(tree[2])} ELSE {text(tree[3])} END" if isinstance(tree, tuple) else f"{tree}D"

        return F.expr(" + ".join(map(text, self.trees)))


@lru_cache(1)
def model(spark: SparkSession) -> tuple[Boosted, dict[str, float]]:
    """The trees and, by kind, the least score for a redaction."""
    made = examples()
    spans = F.from_json(F.lit(json.dumps([dict(zip("mlr", x, strict=False)) for x in made])), "array<struct<m:string,l:string,r:string>>")
    rows = spark.range(1).select(F.posexplode(spans).alias("k", "s")).select("k", F.col("s.m").alias("match"), F.col("s.l").alias("left"), F.col("s.r").alias("right"))
    got = sorted(rows.select("k", *[c.alias(n) for n, c in _features().items()]).collect())
    x, y = [list(r[1:]) for r in got], [e[3] for e in made]
    half = len(x) // 2
    trees = Boosted(x[:half], y[:half])
    scores, least = [trees.score(r) for r in x[half:]], {}
    for k, kind in enumerate(KINDS):
        own = sorted(((s, t) for r, s, t in zip(x[half:], scores, y[half:], strict=True) if r[k]), reverse=True)
        right, least[kind] = 0, math.inf
        for n, (s, t) in enumerate(own, 1):
            right += t
            if right / n >= PRECISION and t:
                least[kind] = max(s, 0.0)
    return trees, least


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_hash, spans (kind, number of the kind, start, end, base, score), by kind and start."""
    spark = docs.sparkSession
    held = written(candidates(docs), "pii-candidates")
    each = held.filter(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*").repartition("rid")
    run = Window.partitionBy("rid", "generator").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(run)).withColumn("start", F.col("end") - F.length("match"))
    valid = F.coalesce(*[F.when(F.col("generator") == k, _valid(k, F.col("match"))) for k in BASE], F.lit(True))
    base = F.col("generator").isin(*BASE)
    kind = F.when(base, F.col("generator")).otherwise(F.coalesce(*[F.when(F.col("match").rlike(p), F.lit(k)) for k, p in KINDS.items()]))
    each = each.withColumns({"base": base, "kind": kind}).filter(valid)
    trees, least = model(spark)
    named = _features()
    scored = each.select("rid", "kind", "base", "start", "end", *[F.when(~base, c).alias(n) for n, c in named.items()])
    enough = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in least.items() if v < math.inf], F.lit(float("inf")))
    scored = scored.select("rid", "kind", "base", "start", "end", F.when(F.col("base"), F.lit(None)).otherwise(trees.sql(list(named))).alias("score")).filter(F.col("base") | (F.col("score") >= enough))
    # of overlapping spans the base ones stay: the latest end before a span and the earliest start after it
    by_start = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_end = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_start)
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_end)
    kept = scored.withColumns({"before": before, "after": after}).filter(F.col("base") | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))))
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ORDER)])
    one = F.struct(number.alias("number"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "base", "score")
    spans = kept.groupBy("rid").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    empty = F.expr("cast(array() as array<struct<number:int,start:bigint,end:bigint,kind:string,base:boolean,score:double>>)")
    return held.select("rid", "doc_id", "row_hash").join(spans, "rid", "left").select("doc_id", "row_hash", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, all columns kept. Overlapping spans are replaced as one, under the first one's kind."""
    spans = find_pii(docs).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "row_hash"])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = written(spans.select(F.col("doc_id").alias("__pii_id"), F.col("row_hash").alias("__pii_hash"), ordered.alias("__pii_spans")), "pii-spans")
    met = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__pii_id")) & (F.xxhash64("text") == F.col("__pii_hash")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    piece = lambda a, s: F.when(s["start"] >= a["at"], F.concat(a["done"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["done"])
    text = F.aggregate("__pii_spans", start, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), piece(a, s).alias("done")), lambda a: F.concat(a["done"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return met.select(*[(F.when(F.col("__pii_spans").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(c)) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
