"""Album hints that are worth searching by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from . import scoring as S

# From which similarity a hint is the title, up to which length it may be the name of the album too, and the length of a part that is a title.
SAME, SELF_TITLED, PART = 0.92, 20, 4


def usable_hints(df: DataFrame, hint: str, title: str) -> DataFrame:
    """``df`` with its hints cut or emptied.

    Of 'album - title' the first part stays, unless one of them names an edition. A hint that is the title, or nearly, is one only if it
    is short or names an edition; a title with an album suffix is none.
    """
    given = T.text_or_empty(F.col(hint))
    first, second = T.stripped(F.substring_index(given, " - ", 1)), T.stripped(F.substring(given, F.locate(" - ", given) + 3, F.length(given)))
    edition = lambda c: F.size(T.edition_tokens(c)) > 0
    cut = F.contains(given, F.lit(" - ")) & (F.length(second) > PART) & ~edition(second) & ~edition(first)
    rows = df.withColumn("own_", F.when(cut, first).otherwise(given)).withColumns({"a_": T.normalize(F.col("own_")), "b_": T.normalize(F.col(title))})
    known = S.distances(rows, {"like_": ("a_", "b_")}, D.title_similarity)
    short = F.length(F.replace("a_", F.lit(" "))) <= SELF_TITLED
    suffixed = T.has_album_suffix(F.col("a_")) & (T.without_album_suffix(F.col("a_")) == F.col("b_"))
    same = (F.col("like_") >= SAME) & ~edition(F.col("a_")) & ~short
    none = (F.col("own_") == "") | F.when(F.col("a_") == F.col("b_"), ~short).otherwise(suffixed | same)
    return known.withColumn(hint, F.when(none, "").otherwise(F.col("own_"))).drop("own_", "a_", "b_", "like_")
