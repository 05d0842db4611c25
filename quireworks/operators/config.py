"""Brand forms to resolved configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def brand_fields(forms: DataFrame) -> DataFrame:
    """forms: project, text. One row per filled field: project, key, value. A bold label opens a field; a heading or a rule closes it; blank lines part its paragraphs;
    unknown labels are dropped; of a repeated field the last counts."""
    lines = F.transform(F.split(T.without_comments(F.col("text")), r"\r?\n"), T.trim)
    rows = forms.select("project", F.posexplode(lines).alias("i", "line"))
    opens = T.has(F.col("line"), P.FIELD)
    closes = T.has(F.col("line"), r"^(#|---)")
    w = Window.partitionBy("project").orderBy("i")
    rows = rows.withColumns({"opens": opens, "part": F.sum((opens | closes).cast("int")).over(w)})
    label = F.lower(T.trim(T.sub(F.regexp_extract("line", P.FIELD, 1), rf"(?i){P.SPACE}*\((required|optional)\){P.SPACE}*\z", "")))
    known = F.create_map(*[F.lit(x) for pair in P.FIELDS.items() for x in pair])
    value = F.when(F.col("opens"), F.nullif(T.trim(F.regexp_extract("line", P.FIELD, 2)), F.lit(""))).when(F.col("line") == "", "\n\n").otherwise(F.col("line"))
    rows = rows.groupBy("project", "part").agg(
        F.max(F.when(F.col("opens"), F.try_element_at(known, label))).alias("key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("i", value.alias("v"))))), lambda x: x["v"]), " ").alias("raw"),
    )
    text = T.trim(T.sub(F.col("raw"), rf"{P.SPACE}*\n\n{P.SPACE}*", "\n\n"))
    rows = rows.where("key IS NOT NULL").select("project", "part", "key", text.alias("value"))
    return rows.groupBy("project", "key").agg(F.max_by("value", "part").alias("value"))


def wide(fields: DataFrame) -> DataFrame:
    """One row per project, a column for each field; blank counts as absent."""
    keys = list(dict.fromkeys(P.FIELDS.values()))
    return fields.groupBy("project").agg(*(F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value"))).alias(k) for k in keys))


def needs_disclaimer(niche: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.coalesce(niche, F.lit(""))), F.lower(t)))


def resolved(fields: DataFrame, theme: dict[str, dict[str, str]], terms: list[str]) -> DataFrame:
    """User fields over the theme's fonts and palette, with the missing required fields listed (empty: the configuration holds)."""
    rows = wide(fields).withColumn("disclaimer_required", needs_disclaimer(F.col("niche"), terms))
    missing = F.array_compact(F.array(*(F.when(F.col(k).isNull(), k) for k in P.REQUIRED_FIELDS), F.when(F.col("disclaimer_required") & F.col("disclaimer").isNull(), "disclaimer")))
    own = {"bg": "background", "bgAlt": "backgroundAlt", "heading": "headingColor"}
    colour = lambda k: F.coalesce(T.hex_colour(F.col(own.get(k, k))), F.lit(theme["palette"].get(k))).alias(f"palette_{k}")
    font = lambda role: F.coalesce(F.col(f"font{role.capitalize()}"), F.lit(theme["fonts"][role])).alias(f"font_{role}")
    points = F.filter(F.transform(F.split(F.coalesce("backCoverBullets", F.lit("")), r"\n\n+"), lambda b: T.trim(T.sub(b, rf"^[-*]{P.SPACE}*", ""))), lambda b: b != "")
    return rows.select("project", "title", "subtitle", "author", "niche", "disclaimer", "disclaimer_required", "ctaTitle", "ctaContent", "ctaLink", "ctaLinkLabel", "backCoverPunchline", points.alias("backCoverBullets"), *(colour(k) for k in P.PALETTE_VARIABLES), *(font(r) for r in ("body", "heading", "mono")), missing.alias("missing"))


def style_variables(config: DataFrame) -> DataFrame:
    """resolved() as rows (project, variable, value), the fonts as stacks."""
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(f"palette_{k}").alias("value")) for k, v in P.PALETTE_VARIABLES.items()]
    pairs += [F.struct(F.lit(f"font-{r}").alias("variable"), T.font_stack(F.col(f"font_{r}"), r).alias("value")) for r in ("body", "heading", "mono")]
    return config.select("project", F.inline(F.array(*pairs)))


def word_groups(config: DataFrame) -> DataFrame:
    """Copy that comes from the configuration, as groups in the order they draw: project, name, priority, text. A group is there exactly when assembly shows it."""
    filled = lambda c: F.coalesce(T.trim(F.col(c)), F.lit("")) != ""
    link = F.when(filled("ctaLink") & filled("ctaLinkLabel"), F.col("ctaLinkLabel"))
    group = lambda name, n, cond, text: F.when(cond, F.struct(F.lit(name).alias("name"), F.lit(n).alias("priority"), text.alias("text")))
    groups = F.array_compact(F.array(
        group("disclaimer", 0, filled("disclaimer"), F.col("disclaimer")),
        group("CTA", 1, filled("ctaTitle") & filled("ctaContent"), F.concat_ws(" ", "ctaTitle", "ctaContent", link)),
        group("back cover", 2, filled("backCoverPunchline") & (F.size("backCoverBullets") > 0), F.concat_ws(" ", "backCoverPunchline", F.array_join("backCoverBullets", " "))),
    ))
    return config.select("project", F.inline(groups))
