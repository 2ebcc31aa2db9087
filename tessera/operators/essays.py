"""Essay feedback: comments matched to the segments of an essay.

segments (essay_id, para_seq, seg_seq, text, comment_id, comment_after, italic);
comments (comment_id, text); selection (essay_id, position, comment_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import last_word, padded


def selected(selection: DataFrame, comments: DataFrame) -> DataFrame:
    """The comments chosen, in the order given, numbered with two digits."""
    return selection.join(comments, "comment_id").withColumn("number", padded(F.col("position") + 1))


def missing(selection: DataFrame, comments: DataFrame) -> DataFrame:
    """Choices that name no comment."""
    return selection.join(comments.select("comment_id"), "comment_id", "left_anti")


def annotated(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """segments with number and text of their chosen comment, kind, and the split highlight.

    A segment of a comment that was not chosen is plain text; ``lead`` and ``tail``
    part a highlight at its last space.  ``panel_comment`` is the chosen comment
    that shows after the segment on small screens.
    """
    by = chosen.select("essay_id", "comment_id", F.col("number"), F.col("text").alias("comment"))
    out = segments.join(by, ["essay_id", "comment_id"], "left")
    panel = chosen.select("essay_id", F.col("comment_id").alias("comment_after"), F.col("comment_id").alias("panel_comment"))
    out = out.join(panel, ["essay_id", "comment_after"], "left")
    mark = F.col("number").isNotNull()
    return out.withColumns({
        "kind": F.when(mark, "comment").when(F.coalesce("italic", F.lit(False)), "italic").otherwise("text"),
        "lead": F.when(mark, last_word(F.col("text"))["lead"]), "tail": F.when(mark, last_word(F.col("text"))["tail"]),
    })


def paragraphs(segments: DataFrame) -> DataFrame:
    """Text of each paragraph, rebuilt from its segments in order."""
    gathered = segments.groupBy("essay_id", "para_seq").agg(F.array_sort(F.collect_list(F.struct("seg_seq", "text"))).alias("g"))
    return gathered.select("essay_id", "para_seq", F.array_join(F.transform("g", lambda x: x["text"]), "").alias("text"))
