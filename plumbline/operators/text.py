"""Free text: characters, words, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs

STOP_WORDS = tuple(
    """'d 'll 'm 're 's 've a about above across after afterwards again against ain all almost alone along already also although always am among amongst amount an and another any anyhow anyone
    anything anyway anywhere are aren aren't around as at back be became because become becomes becoming been before beforehand behind being below beside besides between beyond both bottom but
    by ca call can cannot cant could couldn couldn't couldnt d did didn didn't didnt do does doesn doesn't doing don don't done dont down due during each eight either eleven else elsewhere empty
    enough even ever every everyone everything everywhere except few fifteen fifty first five for former formerly forty four from front full further get give go had hadn hadn't has hasn hasn't
    hasnt have haven haven't havent having he hence her here hereafter hereby herein hereupon hers herself hes him himself his how however hundred i if in indeed into is isn isn't isnt it it's
    its itself just keep last latter latterly least less ll m ma made make many may me meanwhile might mightn mightn't mightnt mightve mine more moreover most mostly move much must mustn mustn't
    my myself n't namely needn needn't neednt neither never nevertheless next nine no nobody none noone nor not nothing now nowhere n‘t n’t o of off often on once one only onto or other others
    otherwise our ours ourselves out over own part per perhaps please put quite rather re really regarding s same say see seem seemed seeming seems serious several shan shan't she she's shes
    should should've shouldn shouldn't shouldnt shouldve shoulve show side since six sixty so some somehow someone something sometime sometimes somewhere still such t take ten than that that'll
    thatllwas the their theirs them themselves then thence there thereafter thereby therefore therein thereupon these they third this those though three through throughout thru thus to together
    too top toward towards twelve twenty two under unless until up upon us used using various ve very via was wasn wasn't wasnt we well were weren weren't werent what whatever when whence
    whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without won won't wont would wouldn
    wouldn't wouldnt y yet you you'd you'll you're you've your youre yours yourself yourselves youve ‘d ‘ll ‘m ‘re ‘s ‘ve ’d ’ll ’m ’re ’s ’ve""".split()
)


def filled(df: DataFrame, column: str) -> DataFrame:
    """(text) of the cells that aren't blank."""
    return df.select(F.col(f"`{column}`").cast("string").alias("text")).filter(~F.col("text").rlike(r"\A\s*\z"))


def char_counts(df: DataFrame, column: str) -> DataFrame:
    """(char, n) over all texts; counted within a partition before they are shuffled."""
    return filled(df, column).select(F.explode(exprs.characters(F.col("text"))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def word_counts(df: DataFrame, column: str, case_sensitive: bool = True, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(word, n) without stop words, whose case never counts."""
    text = F.col("text") if case_sensitive else F.lower("text")
    words = filled(df, column).select(F.explode(exprs.split_words(text)).alias("word"))
    if stop_words:
        words = words.filter(~F.lower("word").isin(*stop_words))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(k)


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n_lines, empty_lines, memory in MB."""
    c = F.col(f"`{column}`").cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.coalesce(c.rlike(r"\A\s*\z"), F.lit(True))).alias("empty_lines"), (F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) / 1024**2).alias("memory_mb"))


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, char): the characters that each column's cells have."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "text")
    return texts.filter(~exprs.is_null_token(F.col("text"))).select("column_name", F.explode(exprs.characters(F.col("text"))).alias("char")).distinct()
