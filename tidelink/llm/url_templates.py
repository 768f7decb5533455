"""URL filter by path-template trees (DataFrame functions only).

Every url is split into host and path.  Fixed rules (a host with all its
subdomains, and a path beginning) judge what they fit; the longest wins.  The
other urls are judged by the template of their path: paths of one host form a
tree of segments, in which

* digit runs and long hexadecimal segments are wildcards from the start;
* a node with many children, most of them met once or twice, has a variable
  segment: its children become one wildcard;
* siblings whose rule-labelled shares (blocked, allowed) do not differ
  significantly from those of the largest sibling merge into one branch.

Each resulting template has a labelled purity, the smoothed share of blocked
urls among those the rules judge; templates at or over ``REJECT`` are blocked.

The tree is built on counts per (host, generalised path), never on pages; each
level is two partial aggregations and an equi-join over that table, written to
the shared folder.  Pages meet their template in one join on (host, path
shape), whose skewed hosts Spark splits.

Defined results: a null url or one without ``://`` has empty host and path
(verdict by the template of the empty path); repeated rows are judged each; a
page without segments has the template ``/``; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import materialise

#: (rule, verdict): host, a slash, path beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEPTH = 4                # levels of the tree; deeper segments share one wildcard
VARIABLE_CHILDREN = 8    # a node with at least so many children ...
VARIABLE_SHARE = 2       # ... and fewer than so many pages a child is variable
CHI_SQUARE = 2.706       # siblings differ beyond this (10 % level, one degree of freedom)
PRIOR, STRENGTH = 0.5, 2.0
REJECT = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest) + F.lit(1)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, tail = rule.partition("/")
    return ((host == F.lit(name)) | host.endswith("." + name)) & path.startswith(slash + tail)


def longest_rule(rules, host: Column, path: Column) -> Column:
    """The rule that judges a url, or null."""
    order = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return F.coalesce(*(F.when(rule_fits(r, host, path), F.lit(r)) for r, _ in order), F.lit(None).cast("string"))


def verdict_of(rules, rule: Column) -> Column:
    return F.coalesce(*(F.when(rule == F.lit(r), F.lit(v)) for r, v in rules), F.lit(None).cast("string"))


def path_levels(path: Column) -> list[Column]:
    """Generalised segments of the first levels ('' where absent), then '**' if there are more."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    general = F.transform(segments, lambda x: F.when(x.rlike("^[0-9a-f]{16,}$"), F.lit("{h}"))
                          .otherwise(F.regexp_replace(x, "[0-9]+", "{n}")))
    levels = [F.coalesce(F.get(general, F.lit(i)), F.lit("")) for i in range(DEPTH)]
    return [*levels, F.when(F.size(segments) > DEPTH, F.lit("**")).otherwise(F.lit(""))]


def _alike(hits: str, n: str, top_hits: str, top_n: str) -> Column:
    """Two-proportion test: no significant difference between hits/n and top_hits/top_n."""
    h, m, th, tm = (F.col(c).cast("double") for c in (hits, n, top_hits, top_n))
    pooled = (h + th) / (m + tm)
    gap = h / m - th / tm
    return gap * gap <= F.lit(CHI_SQUARE) * pooled * (1 - pooled) * (1 / m + 1 / tm)


def generalise_level(tree: DataFrame, level: int) -> DataFrame:
    """Replace the children of one level by wildcards where they are variable or alike."""
    parent, child = ["host", *(f"t{i}" for i in range(1, level))], f"t{level}"
    kids = tree.filter(F.col(child) != "").groupBy(*parent, child).agg(
        F.sum("n").alias("kn"), F.sum("blocked").alias("kb"), F.sum("allowed").alias("ka"))
    fan = kids.groupBy(*parent).agg(
        F.count(F.lit(1)).alias("children"), F.sum("kn").alias("pn"),
        F.max(F.struct("kn", child, "kb", "ka")).alias("top")).select(
        *parent, "children", "pn", F.col("top.kn").alias("tn"), F.col("top.kb").alias("tb"), F.col("top.ka").alias("ta"))
    variable = (F.col("children") >= VARIABLE_CHILDREN) & (F.col("children") * VARIABLE_SHARE >= F.col("pn"))
    alike = (F.col("children") >= 2) & _alike("kb", "kn", "tb", "tn") & _alike("ka", "kn", "ta", "tn")
    decided = kids.join(fan, parent).filter(variable | alike).select(*parent, child, F.lit("*").alias("wild"))
    joined = tree.join(decided, [*parent, child], "left")
    return joined.withColumn(child, F.coalesce("wild", child)).drop("wild")


def template_tree(judged: DataFrame) -> DataFrame:
    """``host, shape, template, purity`` for every (host, path shape) of judged urls.

    ``judged`` has ``host, shape, t1.., t5, rule_verdict``.
    """
    names = [f"t{i}" for i in range(1, DEPTH + 2)]
    tree = materialise(judged.groupBy("host", "shape", *names).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("blocked"),
        F.sum(F.when(F.col("rule_verdict") == "allow", 1).otherwise(0)).alias("allowed")), "url-tree")
    for level in range(1, DEPTH + 1):
        tree = materialise(generalise_level(tree, level), "url-tree")
    named = tree.withColumn("template", F.concat(F.lit("/"), F.array_join(
        F.filter(F.array(*names), lambda x: x != ""), "/")))
    purity = named.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).select(
        "host", "template", ((F.col("b") + F.lit(PRIOR * STRENGTH)) / (F.col("b") + F.col("a") + F.lit(STRENGTH))).alias("purity"))
    return materialise(named.join(purity, ["host", "template"]).select("host", "shape", "template", "purity"), "url-tree")


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    rows = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
            .withColumn("rule_verdict", verdict_of(rules, F.col("rule"))))
    levels = path_levels(F.col("path"))
    rows = rows.select("*", *(c.alias(f"t{i}") for i, c in enumerate(levels, 1))).withColumn(
        "shape", F.concat_ws("/", *(f"t{i}" for i in range(1, DEPTH + 2))))
    found = rows.select("page_id", "host", "path", "rule", "rule_verdict", "shape").join(
        template_tree(rows), ["host", "shape"])
    by_method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_method).alias("verdict"),
                        "template", "purity")


def url_filter(pages: DataFrame, **options) -> DataFrame:
    """The judged urls that are allowed."""
    return judge_urls(pages, **options).filter(F.col("verdict") == "allow")


def oracle_sql(rules=RULES) -> str:
    """DuckDB twin of ``judge_urls`` over ``pages``."""
    names = [f"t{i}" for i in range(1, DEPTH + 2)]
    order = sorted(rules, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        name, slash, tail = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{tail}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in order) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"
    translate = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    levels = ", ".join(f"coalesce(g[{i}], '') AS t{i}" for i in range(1, DEPTH + 1))
    parts = [f"""WITH cut AS (SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0
        THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hp AS (SELECT page_id, {translate} AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
    ruled AS (SELECT *, {rule} AS rule FROM hp),
    seg AS (SELECT *, {verdict} AS rule_verdict, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
        lambda x: CASE WHEN regexp_full_match(x, '[0-9a-f]{{16,}}') THEN '{{h}}'
        ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END) AS g FROM ruled),
    rows_ AS (SELECT *, {levels}, CASE WHEN len(g) > {DEPTH} THEN '**' ELSE '' END AS t{DEPTH + 1} FROM seg),
    shaped AS (SELECT *, concat_ws('/', {', '.join(names)}) AS shape FROM rows_),
    tree0 AS (SELECT host, shape, {', '.join(names)}, count(*) AS n,
        sum(CASE WHEN rule_verdict = 'block' THEN 1 ELSE 0 END) AS blocked,
        sum(CASE WHEN rule_verdict = 'allow' THEN 1 ELSE 0 END) AS allowed FROM shaped GROUP BY ALL)"""]

    def alike(h: str, t: str) -> str:
        pooled = f"(({h} + {t})::DOUBLE / (kn + tn))"
        gap = f"({h}::DOUBLE / kn - {t}::DOUBLE / tn)"
        return f"{gap} * {gap} <= {CHI_SQUARE} * {pooled} * (1 - {pooled}) * (1::DOUBLE / kn + 1::DOUBLE / tn)"

    for d in range(1, DEPTH + 1):
        parent = ", ".join(["host", *names[:d - 1]])
        child = names[d - 1]
        on = " AND ".join(f"x.{c} = y.{c}" for c in ["host", *names[:d]])
        parts.append(f"""kids{d} AS (SELECT {parent}, {child}, sum(n) AS kn, sum(blocked) AS kb, sum(allowed) AS ka
        FROM tree{d - 1} WHERE {child} <> '' GROUP BY {parent}, {child}),
    fan{d} AS (SELECT *, count(*) OVER p AS children, sum(kn) OVER p AS pn, first_value(kn) OVER q AS tn,
        first_value(kb) OVER q AS tb, first_value(ka) OVER q AS ta FROM kids{d}
        WINDOW p AS (PARTITION BY {parent}), q AS (PARTITION BY {parent} ORDER BY kn DESC, {child} DESC)),
    dec{d} AS (SELECT {parent}, {child} FROM fan{d} WHERE
        (children >= {VARIABLE_CHILDREN} AND children * {VARIABLE_SHARE} >= pn)
        OR (children >= 2 AND {alike('kb', 'tb')} AND {alike('ka', 'ta')})),
    tree{d} AS (SELECT x.* REPLACE (CASE WHEN y.host IS NULL THEN x.{child} ELSE '*' END AS {child})
        FROM tree{d - 1} x LEFT JOIN dec{d} y ON {on})""")
    parts.append(f"""named AS (SELECT *, '/' || array_to_string(list_filter([{', '.join(names)}], lambda x: x <> ''), '/')
        AS template FROM tree{DEPTH}),
    pure AS (SELECT host, template, (sum(blocked) + {PRIOR * STRENGTH}) / (sum(blocked) + sum(allowed) + {STRENGTH})
        AS purity FROM named GROUP BY host, template)
    SELECT s.page_id, s.host, s.path, s.rule,
        coalesce(s.rule_verdict, CASE WHEN p.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
        n.template, p.purity
    FROM shaped s JOIN named n ON s.host = n.host AND s.shape = n.shape
    JOIN pure p ON n.host = p.host AND n.template = p.template""")
    return ",\n    ".join(parts)
