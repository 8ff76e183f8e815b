"""Code text to comparable features, as column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# fixed values: business vocabulary looked for in the raw text, aggregate names, parameters that
# are not sources
CONCEPTS = (
    "revenue", "recogniz", "refund", "credit", "invoice", "order", "netting", "net",
    "currency", "fx", "exchange", "reporting", "customer", "active", "arpac", "gross",
    "amount", "tax", "discount", "margin", "cost", "price", "quantity", "subscription",
)
SQL_AGGREGATES = ("sum", "count", "avg", "average", "min", "max", "mean", "median")
PYTHON_AGGREGATES = ("sum", "count", "avg", "mean", "min", "max")
NOT_SOURCES = ("self", "start_date", "end_date")
PYTHON_STARTS = r'^[ \t\r\n\f]*(def |import |from |"""|#|@)'

WS = "[ \\t\\r\\n\\f]+"
LEX = "[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n\\f]"


def detect_lang(text: Column, hint: Column | None = None) -> Column:
    guess = F.when(text.rlike(PYTHON_STARTS), "python").otherwise("sql")
    return guess if hint is None else F.when(hint.isin("sql", "python"), hint).otherwise(guess)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS, " "))


def strip_sql(text: Column) -> Column:
    """Function body if there is one, without templates and comments."""
    body = F.when(text.rlike(r"(?s)\$\$.*?\$\$"), F.regexp_extract(text, r"(?s)\$\$(.*?)\$\$", 1)).otherwise(text)
    for noise in (r"(?s)\{\{.*?\}\}|\{%.*?%\}", r"(?s)/\*.*?\*/", r"--[^\n]*"):
        body = F.regexp_replace(body, noise, " ")
    return body


def strip_py(text: Column) -> Column:
    """Without docstrings and comments; a ``#`` inside a string literal stays."""
    for quote in ('"""', "'''"):
        text = F.regexp_replace(text, f"(?sm)^[ \\t]*{quote}.*?{quote}[ \\t]*$", " ")
    return F.regexp_replace(text, r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|#[^\n]*""", "$1")


def normalize_sql(text: Column) -> Column:
    return _squeeze(F.lower(strip_sql(text)))


def normalize_py(text: Column) -> Column:
    return _squeeze(strip_py(text))


def normalize(text: Column, language: Column) -> Column:
    return F.when(language == "python", normalize_py(text)).otherwise(normalize_sql(text))


def tokens(normalized: Column, mode: str = "lex") -> Column:
    if mode == "ws":
        return F.filter(F.split(normalized, " "), lambda t: t != "")
    if mode == "lex":
        return F.regexp_extract_all(normalized, F.lit(LEX), F.lit(0))
    raise ValueError("mode must be 'ws' or 'lex'")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(toks: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` tokens; a shorter text is one run by itself."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return (
            F.when(n >= k, F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i - 1 + j) for j in range(k)]))))
            .when(n > 0, F.array(F.concat_ws(" ", t)))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(toks, runs)


def fingerprint(toks: Column) -> Column:
    return F.sha2(F.concat_ws(" ", toks), 256)


def leaf(name: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(name, "\\."), -1)))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(c))


def _present(options: dict[str, Column]) -> Column:
    """Sorted names whose condition holds."""
    picked = F.array(*[F.when(cond, F.lit(name)) for name, cond in options.items()])
    return _set(F.filter(picked, lambda x: x.isNotNull()))


def concepts(text: Column) -> Column:
    return _spoken(F.lower(text))


def _spoken(low: Column) -> Column:
    return _present({t: low.contains(t) for t in CONCEPTS})


def _aggregates(text: Column, names) -> Column:
    alias = {"average": "avg", "mean": "avg"}
    found: dict[str, Column] = {}
    for n in names:
        hit = text.rlike(rf"\b{n}\s*\(")
        key = alias.get(n, n)
        found[key] = found[key] | hit if key in found else hit
    return _present(found)


def profile_sql(text: Column, strip_comments: bool = False, low: Column | None = None) -> dict[str, Column]:
    """Transformation profile of SQL text. Comments count, as in the raw text, unless stripped. ``low`` is the text in lower case, where that is a column already."""
    if low is None:
        low = F.lower(strip_sql(text) if strip_comments else text)
    read = r"\b(from|join)\s+([a-zA-Z_][\w\.]*)"
    items = F.flatten(F.transform(_all(low, r"group\s+by\s+([\w\.,\s]+)"), lambda g: F.split(g, ",")))
    first_word = F.transform(items, lambda g: F.regexp_extract(g, r"^\s*(\S+)", 1))
    select_list = F.regexp_extract(low, r"(?s)\bselect\b(.*?)\bfrom\b", 1)
    return {
        "source_entities": _set(_all(low, read, 2)),
        "joins": F.size(F.filter(_all(low, read, 1), lambda k: k == "join")),
        "aggregations": _aggregates(low, SQL_AGGREGATES),
        "group_by": _set(F.filter(first_word, lambda g: g != "")),
        "output_columns": _set(_all(select_list, r"\bas\s+([a-z_][a-z0-9_]*)")),
        "concepts": _spoken(low),
    }


def profile_py(text: Column, code: Column | None = None) -> dict[str, Column]:
    """Transformation profile of PySpark source, read off its calls and parameters. ``code`` is the stripped text, where that is a column already."""
    if code is None:
        code = strip_py(text)
    params = F.concat(_all(code, r"\bdef\s+\w+\s*\(([^)]*)\)"), _all(code, r"\blambda\s+([^:]*):"))
    names = F.transform(
        F.flatten(F.transform(params, lambda p: F.split(p, ","))),
        lambda p: F.regexp_extract(p, r"^[\s\*]*([A-Za-z_]\w*)", 1),
    )
    call_args = F.concat_ws(",", _all(code, r"\.(?:groupBy|groupby|agg)\s*\(([^()]*)"))
    return {
        "source_entities": _set(F.filter(names, lambda n: (n != "") & ~n.isin(*NOT_SOURCES))),
        "joins": F.size(_all(code, r"\.(join|merge)\s*\(")),
        "aggregations": _aggregates(code, PYTHON_AGGREGATES),
        "group_by": _set(_all(call_args, r"""["']([^"']+)["']""")),
        "output_columns": _set(
            _all(code, r"""\.(?:withColumn|alias|withColumnRenamed)\s*\(\s*["']([^"']+)["']""")
        ),
        "concepts": concepts(text),
    }


PROFILE = ("source_entities", "joins", "aggregations", "group_by", "output_columns", "concepts")


def profile(text: Column, language: Column, strip_comments: bool = False) -> Column:
    sql, py = profile_sql(text, strip_comments), profile_py(text)
    return F.struct(
        language.alias("language"), *[F.when(language == "python", py[f]).otherwise(sql[f]).alias(f) for f in PROFILE]
    )


def feature_bag(p: Column) -> Column:
    """Profile as one sorted set of typed features, comparable across languages."""

    def typed(prefix: str, field: str, by_leaf: bool) -> Column:
        vals = p[field]
        if by_leaf:
            vals = F.transform(vals, leaf)
        return F.transform(F.filter(vals, lambda v: v != ""), lambda v: F.concat(F.lit(prefix + ":"), v))

    joins = F.when(
        p["joins"] > 0, F.array(F.concat(F.lit("joins:"), F.least(p["joins"], F.lit(3)).cast("string")))
    ).otherwise(F.array().cast("array<string>"))
    bags = [
        typed("src", "source_entities", True), typed("agg", "aggregations", False), typed("grp", "group_by", True),
        typed("out", "output_columns", True), typed("concept", "concepts", False), joins,
    ]
    return _set(reduce(F.concat, bags))


def profile_document(p: Column) -> Column:
    """Profile in words, the text to embed or search."""

    def listed(field: str, by_leaf: bool) -> Column:
        vals = F.transform(p[field], leaf) if by_leaf else p[field]
        return F.concat_ws(", ", F.sort_array(vals))

    def part(words: str, field: str, by_leaf: bool) -> Column:
        return F.when(F.size(p[field]) > 0, F.concat(F.lit(words), listed(field, by_leaf)))

    return F.trim(F.concat_ws(
        ". ",
        F.concat(F.lit("transformation in "), p["language"]),
        F.concat(F.lit("reads "), listed("source_entities", True)),
        F.when(p["joins"] > 0, F.concat(F.lit("joins "), p["joins"].cast("string"), F.lit(" sources"))).otherwise("no joins"),
        part("aggregates ", "aggregations", False),
        part("grouped by ", "group_by", True),
        part("outputs ", "output_columns", True),
        part("business concepts ", "concepts", False),
    ))


#: Tasks per core that the text rules are dealt over.
SLICES = 4


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for rules that cost far more than reading: a small compressed file is one task's read."""
    return df.repartition(SLICES * df.sparkSession.sparkContext.defaultParallelism)


def featurize(df: DataFrame, text: str = "text", hint: str | None = "language", mode: str = "lex") -> DataFrame:
    """Snippet table with language, tokens, fingerprint, shingles, profile and feature bag."""
    df = dealt(df)
    t = F.col(text)
    lang = detect_lang(t, F.col(hint) if hint and hint in df.columns else None)
    # what several rules read is a column of a step of its own: Spark evaluates a rule once for each mention within a step
    bare, low, field = "_bare_text", "_low_text", "_profile_{}".format
    python = F.col("language") == "python"
    steps = df.withColumn("language", lang).withColumns({bare: F.when(python, strip_py(t)).otherwise(strip_sql(t)), low: F.lower(t)})
    py, sql = profile_py(t, F.col(bare)), profile_sql(t, low=F.col(low))
    fields = {f: F.when(python, py[f]).otherwise(sql[f]) for f in PROFILE if f != "concepts"} | {"concepts": _spoken(F.col(low))}
    normal = _squeeze(F.when(python, F.col(bare)).otherwise(F.lower(bare)))
    return (
        steps.withColumns({"tokens": tokens(normal, mode), **{field(f): c for f, c in fields.items()}})
        .withColumn("fingerprint", fingerprint(F.col("tokens")))
        .withColumn("profile", F.struct("language", *[F.col(field(f)).alias(f) for f in PROFILE]))
        .withColumn("bag", feature_bag(F.col("profile")))
        .drop(bare, low, *map(field, PROFILE))
    )
