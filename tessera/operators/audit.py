"""Audits of pages from already extracted tables.

docs (doc_id, edition, lesson_count); pages (doc_id, page, width, height); runs
(doc_id, page, idx, str, a, b, c, d, x, y, w, h); ops (doc_id, page, idx, op,
args ARRAY<DOUBLE>, color); rules (doc_id, page, idx, page_y, width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import canonical, computed
from tessera.operators import replay
from tessera.operators.violations import found, together
from tessera.sources.shared import settle, small

#: Fixed values of the page format, in points, and the markers that pages carry.
A4, TOLERANCE, HEADER_POINTS = (595.276, 841.89), 1.0, 55
RULE_COLOR, RULE_WIDTH, RULE_HEIGHT = "#c6d0c8", 400.0, 0.1
ROW_GAP, GAP_TOLERANCE = 7 / 25.4 * 72, 0.1
SECTIONS = [(1, "STEP1READ", "READINGCOMPREHENSION"), (2, "STEP2THINK", "CRITICALTHINKINGANALYSIS"), (3, "STEP3WRITE", "PARAGRAPHWRITING"), (4, "STEP4SPEAK", "VOCABULARY")]
HOW_TO, COVER, LESSON, CONTINUED = "HOWTOUSETHISWORKBOOK", "READINGWORKBOOK", "LESSON", "CONTINUED"
TEACHER_MARKS = ["TEACHERGUIDANCE", "EXAMPLESTRUCTURERUBRIC"]
FOOTER = r"(?i)Page\s+(\d+)\s+of\s+(\d+)"
_PAGE = ["doc_id", "page"]


def joined_text(runs: DataFrame, keys: list[str], text: str = "str", order: str = "idx", by: str = " ") -> DataFrame:
    """Texts of each key joined in order: the text of one page is the bound of a group."""
    gathered = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("g"))
    return gathered.select(*keys, F.array_join(F.transform("g", lambda x: x[text]), by).alias("text"))


def page_texts(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """pages with text, canonical text, and canonical text of the header band."""
    whole = joined_text(runs, _PAGE)
    top = joined_text(runs.join(pages.select(*_PAGE, "height"), _PAGE).where(F.col("y") >= F.col("height") - HEADER_POINTS), _PAGE).withColumnRenamed("text", "header")
    out = pages.join(whole, _PAGE, "left").join(top, _PAGE, "left")
    empty = F.lit("")
    return out.withColumns({"text": F.coalesce("text", empty), "canonical": canonical(F.coalesce("text", empty)), "header_canonical": canonical(F.coalesce("header", empty))}).drop("header")


def not_a4(width: Column, height: Column) -> Column:
    return (F.abs(width - A4[0]) > TOLERANCE) | (F.abs(height - A4[1]) > TOLERANCE)


def leaves_page(run: Column | None = None) -> Column:
    """An unrotated run, blank ones too, that reaches over an edge by more than the tolerance; empty runs draw nothing."""
    c = F.col
    unrotated = (F.abs(c("b")) < 0.001) & (F.abs(c("c")) < 0.001) & (F.length("str") > 0)
    return unrotated & ((c("x") < -TOLERANCE) | (c("x") + c("w") > c("width") + TOLERANCE) | (c("y") < -TOLERANCE) | (c("y") + c("h") > c("height") + TOLERANCE))


def ruled_lines(ops: DataFrame) -> DataFrame:
    """rules of each page, from its drawing operations replayed in order, in ranges (``replay.drawn_rules``).

    Save and restore keep a stack of (matrix, colour); transforms move the origin by
    their matrices; wide flat paths in the rule's colour count.
    """
    return replay.drawn_rules(ops, _PAGE, RULE_COLOR, RULE_WIDTH, RULE_HEIGHT)


def rule_gaps(rules: DataFrame, keys: list[str], y: str = "page_y", order: list[str] | None = None) -> DataFrame:
    """rules with ``gap``, the distance to the rule above on the same page."""
    above = F.lag(y).over(Window.partitionBy(*keys).orderBy(F.col(y).desc(), *(order or ["idx"])))
    return rules.withColumn("gap", above - F.col(y))


def wrong_gaps(rules: DataFrame) -> DataFrame:
    return rule_gaps(rules, _PAGE).where(F.abs(F.col("gap") - ROW_GAP) > GAP_TOLERANCE)


def rules_per_page(rules: DataFrame) -> DataFrame:
    return rules.groupBy(*_PAGE).agg(F.count("*").alias("rules"))


def footer_numbers(text: Column) -> Column:
    """struct(current, total) that a page's footer prints; null without a footer."""
    return F.when(text.rlike(FOOTER), F.struct(F.regexp_extract(text, FOOTER, 1).cast("long").alias("current"), F.regexp_extract(text, FOOTER, 2).cast("long").alias("total")))


def markers(spark: SparkSession) -> DataFrame:
    """The table of sections, which a user can replace: step, band and running header as canonical text."""
    return spark.createDataFrame(SECTIONS, "step int, band string, name string")


def marked_pages(texts: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, step, name) of pages with a footer and a section's band; ``sections`` replaces ``markers``."""
    sections = markers(texts.sparkSession) if sections is None else small(sections)
    known = sections.agg(F.array_sort(F.collect_list(F.struct("step", "band", "name")))).scalar()
    own = texts.where(footer_numbers(F.col("text")).isNotNull()).select(*_PAGE, "canonical", "header_canonical", F.explode(known).alias("s"))
    own = own.where(F.contains("canonical", F.col("s.band")))
    return own.select(*_PAGE, "header_canonical", "s.step", "s.name")


def rules_of_section(rules: DataFrame, texts: DataFrame, step: int, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, rules) of each page of one section, 0 where a page has none; ``sections`` replaces ``markers``."""
    pages = marked_pages(texts, sections).where(F.col("step") == step).select(*_PAGE).distinct()
    return pages.join(rules_per_page(rules), _PAGE, "left").select(*_PAGE, F.coalesce("rules", F.lit(0)).alias("rules"))


def step_order(docs: DataFrame, texts: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Documents whose steps, in page order, aren't all steps of ``sections`` in order, for each lesson."""
    every = (markers(docs.sparkSession) if sections is None else small(sections)).agg(F.array_sort(F.collect_set(F.col("step").cast("int")))).scalar()
    seen = marked_pages(texts, sections).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "step"))), lambda x: x["step"].cast("int")).alias("seen"))
    both = docs.join(seen, "doc_id", "left").withColumns({"seen": F.coalesce("seen", F.array().cast("array<int>")), "wanted": F.flatten(F.array_repeat(every, F.col("lesson_count").cast("int")))})
    return both.where(F.col("seen") != F.col("wanted"))


#: Words of a run by which a passage is looked for; characters, for passages of one or two words.
RUN_WORDS, RUN_CHARS = 4, 8


def _word_runs(hashes: str, w: int, first: int = 1, less: int = 0) -> Column:
    """Hashes of every ``w`` words in a row, from hashes of the words; ``less`` words at the end are left out."""
    starts = F.slice(hashes, F.lit(first), F.greatest(F.size(hashes) - (first - 1) - less - w + 1, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(F.col(hashes), i + (first - 1 + k)) for k in range(1, w)], F.lit(w)))


def _char_runs(text: str, w: int) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - w + 1, F.lit(1))), lambda k: F.length(text) >= w)
    return F.transform(starts, lambda k: F.xxhash64(F.substring(text, k, F.lit(w)), F.lit(-w)))


def leak_candidates(texts: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """(_t, _p) of each text and passage that share the passage's rarest run; every text that contains it is there.

    Every run of words inside a passage (its first and last may be cut by what stands
    around it) or, for one of one or two words, of its characters is looked for in the
    texts, by hash.  Their places are counted, and a passage meets only
    the texts of its rarest; one with a run that is nowhere meets none.  A run that all
    texts share thus costs a count, whatever number of passages has it.
    """
    words = lambda c: F.split(c, r"\s+")
    hashes = lambda c: F.transform(words(c), lambda x: F.xxhash64(x))
    asked = computed(passages.where(F.length(passage) > 0).select(F.col(passage_key).alias("_p"), F.col(passage).alias("_passage")), _hashes=hashes(F.col("_passage")))
    whole = F.size("_hashes") >= 3
    width = F.when(whole, F.least(F.size("_hashes") - 2, F.lit(RUN_WORDS))).otherwise(-F.least(F.length("_passage"), F.lit(RUN_CHARS)))
    asked = asked.withColumn("_width", width)
    widths = sorted(r[0] for r in asked.select("_width").distinct().collect())  # at most RUN_WORDS + RUN_CHARS
    none = F.array().cast("array<bigint>")
    inner = F.coalesce(*[F.when(F.col("_width") == w, _word_runs("_hashes", w, 2, 1) if w > 0 else _char_runs("_passage", -w)) for w in widths], none)
    runs = settle(asked.select("_p", F.posexplode(inner).alias("_place", "_run")), "leak-runs")
    own = computed(texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_t"), F.col(text).alias("_text")), _hashes=hashes(F.col("_text")))
    spread = own.select("_t", F.explode(F.concat(none, *[_word_runs("_hashes", w) if w > 0 else _char_runs("_text", -w) for w in widths])).alias("_run"))
    met = settle(spread.join(runs.select("_run").distinct(), "_run", "left_semi"), "leak-met")
    held = met.groupBy("_run").agg(F.count("*").alias("_held"))
    rarest = F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("held"), "_place", "_run")).alias("r")
    anchors = runs.join(held, "_run", "left").groupBy("_p").agg(rarest).where("r.held > 0").select("_p", F.col("r._run").alias("_run"))
    return met.join(anchors, "_run").select("_t", "_p").distinct()


def leaks(texts: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """(key, passage_key) of each text and passage that it contains, for any number of passages.

    Only ids and hashes are spread and joined (``leak_candidates``); the texts of what
    met are fetched and held to ``contains``.  Null and empty passages are in no text.
    """
    met = leak_candidates(texts, passages, key, text, passage_key, passage)
    asked = passages.select(F.col(passage_key).alias("_p"), F.col(passage).alias("_passage"))
    own = texts.select(F.col(key).alias("_t"), F.col(text).alias("_text"))
    found = met.join(asked, "_p").join(own, "_t").where(F.contains("_text", "_passage"))
    return found.select(F.col("_t").alias(key), F.col("_p").alias(passage_key)).distinct()


def leaked_marks(docs: DataFrame, texts: DataFrame, marks: list[str] = TEACHER_MARKS) -> DataFrame:
    """Student documents with a teacher-only mark on some page."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains("canonical", F.lit(m))
    return docs.where(F.col("edition") == "student").join(texts.where(hit).select("doc_id").distinct(), "doc_id", "left_semi")


def continuation_labels(texts: DataFrame) -> DataFrame:
    return texts.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("(?i)continued"))).alias("labels"))


def unexpected_page_counts(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents whose number of pages differs from ``expected`` (doc_id, pages)."""
    have = pages.groupBy("doc_id").agg(F.count("*").alias("found"))
    return expected.join(have, "doc_id", "full").where(~F.col("pages").eqNullSafe(F.col("found")))


def audit_report(docs: DataFrame, pages: DataFrame, violations: DataFrame) -> DataFrame:
    """doc_id, pages, passed and violations of each document: one row each, those without findings too."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    bad = violations.groupBy(F.col("subject").alias("doc_id")).agg(F.count("*").alias("violations"))
    out = docs.select("doc_id").join(counts, "doc_id", "left").join(bad, docs["doc_id"].cast("string") == bad["doc_id"], "left").drop(bad["doc_id"])
    n = F.coalesce("violations", F.lit(0))
    return out.select("doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), (n == 0).alias("passed"), n.alias("violations"))


def audit(docs: DataFrame, pages: DataFrame, runs: DataFrame, rules: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """All violations of documents' pages, ranked as they are met page by page; ``sections`` replaces ``markers``."""
    texts = page_texts(pages, runs).withColumn("pages", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("foot", footer_numbers(F.col("text")))
    doc, page = F.col("doc_id"), F.col("page")
    at = F.concat(F.lit("page "), page.cast("string"))
    cover = (page == 1) | (F.contains("canonical", F.lit(COVER)) & F.contains("canonical", F.lit(LESSON)))
    foot = F.col("foot")
    sized = runs.join(pages, _PAGE)
    how = texts.groupBy("doc_id").agg(F.count_if(F.contains("canonical", F.lit(HOW_TO))).alias("n"))
    late = F.lit(1 << 40)
    return together(
        found(texts, doc, not_a4(F.col("width"), F.col("height")), [page, F.lit(1)], "not_a4", at, F.format_string("page %d is %.2f x %.2f points, not A4", "page", "width", "height")),
        found(sized, doc, leaves_page(), [page, F.lit(2), F.col("idx")], "text_outside", at, F.concat(F.lit("text leaves the page: "), F.substring("str", 1, 40))),
        found(rules.join(pages, _PAGE), doc, (F.col("page_y") < -TOLERANCE) | (F.col("page_y") > F.col("height") + TOLERANCE), [page, F.lit(3), F.col("idx")], "rule_outside", at, F.lit("a response rule leaves the page")),
        found(texts, doc, ~cover & foot.isNull(), [page, F.lit(4)], "no_footer", at, F.lit("expected a page-number footer")),
        found(texts, doc, foot.isNotNull() & ((foot["current"] != page) | (foot["total"] != F.col("pages"))), [page, F.lit(5)], "wrong_footer", at, F.format_string("printed Page %d of %d, expected Page %d of %d", foot["current"], foot["total"], "page", "pages")),
        found(marked_pages(texts, sections), doc, ~F.contains(F.col("header_canonical"), F.col("name")), [page, F.lit(6), F.col("step")], "wrong_header", at, F.format_string("step %d does not have the expected running header", "step")),
        found(texts, doc, F.contains("header_canonical", F.lit(CONTINUED)), [page, F.lit(7)], "continued_header", at, F.lit("running headers must use the section name alone")),
        found(how, doc, F.col("n") != 1, [late, F.lit(1)], "how_to_pages", F.lit("document"), F.format_string("expected exactly one how-to page; found %d", "n")),
        found(step_order(docs, texts, sections), doc, F.lit(True), [late, F.lit(2)], "step_order", F.lit("document"), F.concat(F.lit("observed "), F.array_join(F.col("seen").cast("array<string>"), ", "), F.lit("; expected "), F.array_join(F.col("wanted").cast("array<string>"), ", "))),
        found(leaked_marks(docs, texts), doc, F.lit(True), [late, F.lit(3)], "leak", F.lit("document"), F.lit("teacher-only guidance in a student document")),
    )
