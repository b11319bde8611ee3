"""Secret scans over a trigram inverted index (operator 9), by DataFrame functions alone.

1. A Boolean trigram query is derived from each rule's pattern (``trigram_query``).
2. The index holds postings (trigram, row key), sorted by trigram in every file, for a stated set of trigrams (by
   default those of the rules' queries), and knows that set. It is written to the shared folder and can be kept,
   opened again and searched for other rules: a rule's query is weakened to the trigrams that the index has.
3. The postings a rule asks for are intersected (AND) and united (OR) for each row key: the candidates.
4. Candidates are joined back to their texts, and the pattern itself decides. Rules without a mandatory trigram
   (long hex strings), or whose trigrams the index lacks, scan all texts.

Matches are located without Python: each match is set between two marks, the text is split at the marks, and the
lengths of the parts add up to the offsets (code points, end exclusive).

A row's key is doc_id and a hash of its text. Edge cases: a null text is empty and holds nothing; rows repeated
with equal doc_id and text get equal results; null doc_ids are matched null-safe; marks that the text holds
already are read as another character of no rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melospark.llm.common import stage, texts
from melospark.llm.trigram_query import Query, trigram_query, trigrams_of, weakened

MARK, OTHER_MARK = "\ufdd0", "\ufdd1"  # noncharacters
PLACEHOLDER = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A pattern that Java, RE2 and Python read alike; ``group`` must have ``least`` characters, else the match
    is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))

#: What follows a private key's first line: all up to its last line, which stands before any other five dashes (so the
#: keys of a text are read once, however many first lines it has); or, where that is missing, headers, the run of base64
#: (line breaks may be escaped, lines may be joined by blanks) and its padded rest. A line of 40 or more is written out
#: in part, since RE2 takes no nested counts whose product is over 1000.
_BODY = r"[A-Za-z0-9+/=\x20\t\r\n\\:,\"'>]"
_TO_END = rf"{_BODY}*(?:-{{1,4}}{_BODY}+){{0,16}}-{{5,9}}END[A-Z\x20]{{0,20}}\x20PRIVATE\x20KEY-----"
_RUN = r"[A-Za-z0-9+/=\t\r\n\\]"
_KEY_RUN = rf"(?:[\x20\r\n]{{0,4}}(?:Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]*){{0,3}}[\x20\t\r\n]{{0,4}}{_RUN}{{16,}}(?:\x20{{1,2}}{_RUN * 30}{_RUN}{{10,}}){{0,64}}(?:\x20{{1,2}}[A-Za-z0-9+/]{{0,40}}={{1,2}})?"

#: The base rules, then those the method adds: published token formats. The minimal lengths of access and hex
#: stand in their patterns, since a run that is too short holds no match at any later place either.
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", rf"-----BEGIN[A-Z\x20]{{0,20}}\x20PRIVATE\x20KEY-----(?:{_TO_END}|{_KEY_RUN})?"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), text_hash."""
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


@dataclass(frozen=True)
class TrigramIndex:
    """``postings`` (trigram, doc_id, text_hash) of all rows for each of ``trigrams``; some hundreds of them."""

    postings: DataFrame
    trigrams: frozenset[str]

    def save(self, path: str) -> None:
        self.postings.write.parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        spark.createDataFrame([(t,) for t in sorted(self.trigrams)], "trigram string").coalesce(1).write.parquet(f"{path}/trigrams")

    @staticmethod
    def open(spark: SparkSession, path: str) -> TrigramIndex:
        held = frozenset(r[0] for r in spark.read.parquet(f"{path}/trigrams").collect())
        return TrigramIndex(spark.read.parquet(f"{path}/postings"), held)

    def query(self, rule: Rule) -> Query:
        """The rule's query as far as the index can answer it; None means that the rule must scan all texts."""
        return weakened(trigram_query(rule.pattern), self.trigrams)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, more: frozenset[str] = frozenset()) -> TrigramIndex:
    """Index of ``docs`` for the trigrams of the rules' queries and ``more`` (in lower case). Each trigram is one
    native search of every text, so their number, not the texts' own variety, sets the cost."""
    wanted = sorted(more.union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    folded = keyed(docs).withColumn("folded", F.lower("text"))
    held = F.array_compact(F.array(*(F.when(F.col("folded").contains(t), F.lit(t)) for t in wanted)).cast("array<string>"))
    postings = folded.select("doc_id", "text_hash", F.explode(held).alias("trigram"))
    return TrigramIndex(stage(postings.select("trigram", "doc_id", "text_hash").sortWithinPartitions("trigram"), "postings"), frozenset(wanted))


def _holds(query: Query, found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    parts = [_holds(q, found) for q in query[1]]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, parts)


def candidates(index: TrigramIndex, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, kinds): the rules whose query a row's postings satisfy."""
    asked = {r.kind: q for r in rules if (q := index.query(r)) is not None}
    wanted = sorted(set().union(*map(trigrams_of, asked.values())))
    met = index.postings.where(F.col("trigram").isin(wanted)).groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*(F.when(_holds(q, F.col("found")), F.lit(k)) for k, q in asked.items())).cast("array<string>"))
    return met.select("doc_id", "text_hash", kinds.alias("kinds")).where(F.size("kinds") > 0)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: TrigramIndex | None = None) -> DataFrame:
    """A row per secret: doc_id, text_hash, kind, rank (place of the rule), start, end. ``index`` must be of these
    very rows; it may have been built for other rules."""
    rows = keyed(docs)
    index = index or build_index(docs, rules)
    hits = stage(candidates(index, rules), "candidates").distinct()
    hits = hits.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "kinds")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    looked = rows.join(hits, same).select("doc_id", "text_hash", "text", "kinds")
    for r in rules:
        if index.query(r) is None:
            scanned = rows.where(F.col("text").rlike(r.pattern))
            looked = looked.unionAll(scanned.select("doc_id", "text_hash", "text", F.array(F.lit(r.kind)).alias("kinds")))
    looked = looked.withColumn("text", F.translate("text", MARK, OTHER_MARK))

    def parts(r: Rule) -> Column:
        marked = F.regexp_replace("text", r.pattern, f"{MARK}$0{MARK}")
        return F.struct(F.lit(r.kind).alias("kind"), F.when(F.array_contains("kinds", r.kind), F.split(marked, MARK)).alias("parts"))

    split = looked.select("doc_id", "text_hash", F.explode(F.array(*map(parts, rules))).alias("r"))
    split = split.where(F.size("r.parts") > 1).select("doc_id", "text_hash", "r.kind", F.posexplode("r.parts").alias("i", "part"))
    sized = split.select(
        "doc_id", "text_hash", "kind", "i", F.length("part").cast("long").alias("n"), F.when(F.col("i") % 2 == 1, F.col("part")).alias("match")
    ).distinct()  # repeated rows are one
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i")
    located = sized.withColumn("end", F.sum("n").over(upto)).where(F.col("match").isNotNull())
    long_enough = reduce(
        Column.__or__,
        ((F.col("kind") == r.kind) & (F.length(F.regexp_extract("match", r.pattern, r.group)) >= r.least) for r in rules),
    )
    rank = F.coalesce(*(F.when(F.col("kind") == r.kind, F.lit(k)) for k, r in enumerate(rules)))
    return located.where(long_enough).select(
        "doc_id", "text_hash", "kind", rank.alias("rank"), (F.col("end") - F.col("n")).alias("start"), "end"
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_<kind> of the base rules, base_sha256, spans."""
    found = stage(find_secrets(docs, rules), "secrets")
    spans = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("all"))
    spans = spans.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "all")
    rows = keyed(docs).select("doc_id", "text_hash")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    everything = F.coalesce("all", F.array().cast(spans.schema["all"].dataType))
    base = [r.kind for r in rules if r.base]
    plain = F.filter(everything, lambda s: s["kind"].isin(base))

    def text_of(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count_of(kind: str) -> Column:
        return F.size(F.filter(everything, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", *map(count_of, base), F.sha2(text_of(plain), 256).alias("base_sha256"), text_of(everything).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping secrets are one. An n_chars column follows
    the new text. Documents without secrets stay as they are; none is dropped."""
    found = stage(find_secrets(docs, rules), "secrets")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("opens", F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0))
    run = apart.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cuts = merged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("__cuts"))
    cuts = stage(cuts.select(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__of_hash"), "__cuts"), "cuts")
    text = docs["text"]
    same = docs["doc_id"].eqNullSafe(cuts["__of"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == cuts["__of_hash"])
    cut, n = F.col("__cuts"), F.size("__cuts")
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(1)).otherwise(cut[i - 1]["b"] + 1).cast("int"), (cut[i]["a"] - F.when(i == 0, F.lit(0)).otherwise(cut[i - 1]["b"])).cast("int")),
            F.lit(placeholder),
        ),
    )
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, (cut[n - 1]["b"] + 1).cast("int"), F.length(text)))
    joined = docs.join(cuts, same, "left").withColumn("__clean", F.when(cut.isNotNull(), clean).otherwise(text))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__clean").alias("text"))
        elif c == "n_chars":
            out.append(F.when(cut.isNotNull(), F.length("__clean")).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(docs[c])
    return joined.select(*out)
