"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of every text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger says which (blob, rule version)
pairs have been scanned and what was found; a run scans only pairs that it lacks, one representative row for each blob, and
joins the findings back to all paths that hold the blob. Texts are never grouped: the representative of a blob is picked on
ids and hashes, and a semi join on (path, blob) fetches its text, so that a blob with very many paths stays spread out.

Spans are in code points, end exclusive, leftmost and non-overlapping for each rule, and cover the whole match.

Defined cases: a null text is the empty blob; an empty text has no findings; null paths are kept as one path; repeated rows
get the same findings each; an empty table yields empty results; other columns pass through, and working columns carry a
prefix of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.quality import let
from mnemoloom.session import stash

SPANS = "array<struct<start:bigint,end:bigint>>"
P = "__s_"
#: Tasks that the paths of one blob are dealt out to.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` is Java regex; a match counts if ``group`` has ``least`` characters. ``version`` changes with the pattern."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: A run that is too short can't hide a longer match of the next two, so their least length stands in the pattern; the first
#: drops short values after matching, as a dropped match still uses up its text.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
EXTRA = (
    # with its body: runs of base64, then the last short one if the end line follows
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[ \t\r\n]+[A-Za-z0-9+/=]{16,})*(?:(?:[ \t\r\n]+[A-Za-z0-9+/=]+)?[ \t\r\n]*-----END [A-Z ]*PRIVATE KEY-----)?", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + EXTRA


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find_spans(text: Column, rule: Rule) -> Column:
    """Spans of ``rule`` in ``text``: what lies between the matches and the matches themselves add up to the places."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    hits = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    if rule.group:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x).cast("long"))
    else:
        sizes = hits
    steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), sizes.alias("size"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["hit"], zero)
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, add, lambda acc: acc["spans"])).otherwise(F.array().cast(SPANS))


def empty_ledger(spark) -> DataFrame:
    """Ledger rows: a blob, the rule keys scanned in one run, and the spans of those that matched."""
    return spark.createDataFrame([], f"blob_id string, rule_keys array<string>, found array<struct<kind:string,rule_key:string,spans:{SPANS}>>")


def scan(versions: DataFrame, path: str, text: str = "text", ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new_rows): each row of ``versions`` as (path, blob_id), and the ledger rows that this run adds.

    ``versions`` holds every historical version as a row. Append ``new_rows`` to the ledger and pass it to the next run.
    """
    keys = [r.key for r in rules]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = versions.select(F.col(path).alias(f"{P}path"), body.alias(f"{P}text"), blob_id(body).alias(f"{P}blob"))
    paths = rows.select(f"{P}path", f"{P}blob")
    blobs = paths.groupBy(f"{P}blob").agg(F.min(f"{P}path").alias(f"{P}rep"))
    if ledger is None:
        todo = blobs.withColumn(f"{P}seen", F.array().cast("array<string>"))
    else:
        seen = (
            ledger.select(F.col("blob_id").alias(f"{P}blob"), F.explode("rule_keys").alias("key"))
            .where(F.col("key").isin(keys))
            .groupBy(f"{P}blob")
            .agg(F.collect_set("key").alias(f"{P}seen"))
        )
        todo = blobs.join(seen, f"{P}blob", "left").withColumn(f"{P}seen", F.coalesce(f"{P}seen", F.array().cast("array<string>")))
        todo = todo.where(F.size(f"{P}seen") < len(keys))
    todo = todo.select(F.col(f"{P}blob").alias(f"{P}b"), f"{P}rep", f"{P}seen")
    same = (F.col(f"{P}blob") == F.col(f"{P}b")) & F.col(f"{P}path").eqNullSafe(F.col(f"{P}rep"))
    unseen = rows.join(todo.hint("shuffle_hash"), same, "inner")
    found = [
        F.when(
            ~F.array_contains(f"{P}seen", rule.key),
            F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule_key"), find_spans(F.col(f"{P}text"), rule).alias("spans")),
        )
        for rule in rules
    ]
    new_rows = unseen.select(
        F.col(f"{P}blob").alias("blob_id"),
        F.array_except(F.array(*map(F.lit, keys)), f"{P}seen").alias("rule_keys"),
        F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["spans"]) > 0)).alias("found"),
    )
    return paths.select(F.col(f"{P}path").alias("path"), F.col(f"{P}blob").alias("blob_id")), new_rows


def findings(paths: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """(path, blob_id, found) of every path: all current rules' findings, in the order of ``rules``."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kinds = (
        ledger.select("blob_id", F.explode("found").alias("f"))
        .where(F.col("f.rule_key").isin([r.key for r in rules]))
        .dropDuplicates(["blob_id", "f"])
        .groupBy("blob_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.element_at(order, F.col("f.rule_key")).alias("o"), F.col("f.kind").alias("kind"), F.col("f.spans").alias("spans")))).alias("found"))
    )
    none = F.array().cast(f"array<struct<o:int,kind:string,spans:{SPANS}>>")
    # the paths of one blob are dealt out over SALTS tasks; only blobs with findings are repeated for that
    spread = kinds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["blob_id", "salt"], "left").select("path", "blob_id", F.coalesce("found", none).alias("found"))


def spans_text(found: Column, kinds) -> Column:
    """``kind:start:end``, by start, then by the order of ``kinds``, joined by commas."""
    flat = F.flatten(F.transform(F.filter(found, lambda f: f["kind"].isin(list(kinds))), lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("s"), f["o"].alias("o"), s["end"].alias("e"), f["kind"].alias("k")))))
    return F.array_join(F.transform(F.sort_array(flat), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with ``mark`` in place of every span; spans that overlap or touch become one mark."""
    zero, longs = F.lit(0).cast("long"), "array<struct<start:bigint,end:bigint>>"
    spans = F.sort_array(F.flatten(F.transform(found, lambda f: f["spans"])))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"]), grown).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(spans, F.array().cast(longs), merge)
    begin = F.struct(zero.alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(text: Column, acc: Column, x: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(kept, F.lit(mark))).alias("parts"))

    def close(text: Column, acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    return F.when(F.size(found) == 0, text).otherwise(let(text, lambda t: F.aggregate(merged, begin, lambda acc, x: cut(t, acc, x), lambda acc: close(t, acc))))


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with every finding blotted out of the text; a column n_chars follows the new text."""
    paths, new_rows = scan(docs, key, text, None, rules)
    hits = findings(paths.distinct(), stash(new_rows, "secret-ledger"), rules).where(F.size("found") > 0)
    hits = hits.select(F.col("path").alias(f"{P}path"), F.col("blob_id").alias(f"{P}blob"), F.col("found").alias(f"{P}found"))
    marked = docs.withColumn(f"{P}b", blob_id(F.col(text)))
    joined = marked.join(hits.hint("shuffle_hash"), (F.col(f"{P}b") == F.col(f"{P}blob")) & F.col(key).eqNullSafe(F.col(f"{P}path")), "left")
    new_text = F.when(F.col(f"{P}found").isNull(), F.col(text)).otherwise(redact(F.col(text), F.col(f"{P}found")))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {text: new_text.alias(text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(f"{P}found").isNull(), F.col("n_chars")).otherwise(F.length(new_text).cast("long")).alias("n_chars")
    return joined.select(*[out[c] for c in docs.columns])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the SHA-256 over their spans and all spans, for each document."""
    paths, new_rows = scan(docs, key, text)
    found = findings(paths, stash(new_rows, "secret-ledger"))
    kinds = [r.kind for r in BASE]
    of = lambda kind: F.coalesce(F.aggregate(F.filter("found", lambda f: f["kind"] == kind), F.lit(0), lambda n, f: n + F.size(f["spans"])), F.lit(0)).cast("long")
    return found.select(
        F.col("path").alias(key),
        *[of(k).alias(f"n_{k}") for k in kinds],
        F.sha2(spans_text(F.col("found"), kinds).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("found"), [r.kind for r in RULES]).alias("spans"),
    )
