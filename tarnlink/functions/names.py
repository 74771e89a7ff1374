"""Business-name standardization (N01-N21) as DataFrame steps; Python only where a text is not ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .unicode import compose, to_latin

# ---- fixed values: spellings that results depend on ----
LEGAL = {
    "private": "pvt", "pvt": "pvt", "pvte": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "lmtd": "ltd", "limtd": "ltd", "public": "public",
    "incorporated": "inc", "incorporation": "inc", "incorp": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "corpn": "corp",
    "company": "co", "co": "co", "cie": "co", "compagnie": "co", "llc": "llc", "llp": "llp", "lp": "lp", "pllc": "pllc", "pc": "pc", "plc": "plc", "opc": "opc",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "eurl": "eurl", "sci": "sci", "snc": "snc", "ei": "ei",
    "gmbh": "gmbh", "srl": "srl", "pty": "pty", "bhd": "bhd",
}
LEGAL_TYPOS = {"limited": "ltd", "private": "pvt", "company": "co", "corporation": "corp", "incorporated": "inc"}
LEGAL_PHRASES = (
    (r"\bltd liability co\b", "llc"),
    (r"\bltd liability partnership\b", "llp"),
    (r"\bprofessional corp\b", "pc"),
    (r"\bpublic ltd(?: co)?\b", "plc"),
    (r"\bp ltd\b", "pvt ltd"),
    (r"\bsociete a responsabilite ltd(?:ee)?\b", "sarl"),
    (r"\bsociete par actions simplifiee\b", "sas"),
    (r"\bsociete civile immobiliere\b", "sci"),
    (r"\bsociete anonyme\b", "sa"),
)
HONORIFICS = ("mr", "smt", "dr", "sri", "shri", "m s")
VARIANTS = {"sree": "shree", "et": "and", "etablissements": "ets", "etablissement": "ets"}
LOOKALIKE = ("01568", "olsbg")
ALIAS = r"(?i)\s(?:d/b/a|a/k/a|t/a|doing business as|also known as|trading as)\s"
TLDS = "com|net|org|in|co|io|biz|info|fr|us|ai|app|shop|store|online|site|tech"
APOSTROPHES = "[’‘'`´ʼ]"
DOMAIN = rf"(?i)^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:{TLDS})(?:\.[a-z]{{2}})?(?:/\S*)?$"
# ---- end of fixed values ----

FORMS = sorted(set(LEGAL.values()) - {"public"} | {"plc"})
#: Dots of a run of single letters at a word's start: the first if another pair follows, the others if one stands before.
ACRONYM_DOT = r"(?<=\b[a-z])\.(?=[a-z]\.)|(?<=\b[a-z]\.(?:[a-z]\.){0,20}[a-z])\."


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def strip_alias(text: Column) -> Column:
    """What follows the last alias mark, unless blank."""
    last = F.element_at(F.split(text, ALIAS, -1), -1)
    return F.when(F.trim(last) != "", last).otherwise(text)


def strip_website(text: Column) -> Column:
    """What stands before a bar, unless blank; each token that is an address becomes its label."""
    head = F.element_at(F.split(text, r"\|", -1), 1)
    head = F.when(F.trim(head) != "", head).otherwise(text)
    tokens = F.filter(F.split(head, r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, DOMAIN, "$1")), " ")


def join_acronyms(text: Column) -> Column:
    """N10."""
    return F.regexp_replace(text, ACRONYM_DOT, "")


def undo_lookalikes(token: Column) -> Column:
    """0 1 5 6 8 in a token with three letters become o l s b g."""
    read = F.translate(token, *LOOKALIKE)
    letters = F.length(F.regexp_replace(token, "[^a-z]", ""))
    return F.when(read.rlike("^[a-z]+$") & (letters >= 3), read).otherwise(token)


def drop_honorifics(text: Column) -> Column:
    """Leading honorifics go, unless nothing would remain."""
    short = F.regexp_replace(text, f"^(?:(?:{'|'.join(HONORIFICS)})(?: |$))+", "")
    return F.when(short != "", short).otherwise(text)


def legal_token(token: Column) -> Column:
    """Canonical legal form by spelling, or by one edit or swap from a long legal word."""
    out = F.element_at(literal_map(LEGAL), token)
    guess = F.lit(None).cast("string")
    for word, form in reversed(LEGAL_TYPOS.items()):
        swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)})
        guess = F.when((F.levenshtein(token, F.lit(word)) <= 1) | token.isin(swaps), F.lit(form)).otherwise(guess)
    return F.coalesce(out, F.when(F.length(token) >= 6, guess), token)


def standardize_names(df: DataFrame, name: str, out: str = "name_std", core: str | None = "name_core", word_map: dict[str, str] | None = None) -> DataFrame:
    """Adds out, the canonical name (legal forms last), and core, the name without them (all of it if only forms)."""
    df = df.withColumn("_n", compose(F.coalesce(F.col(name), F.lit(""))))
    df = df.withColumn("_n", strip_alias(F.col("_n"))).withColumn("_n", strip_website(F.col("_n")))
    df = df.withColumn("_n", F.lower(to_latin(F.col("_n"), word_map)))
    text = F.regexp_replace(F.regexp_replace(F.col("_n"), APOSTROPHES, ""), "&", " and ")
    text = F.regexp_replace(join_acronyms(text), r"[^a-z0-9\s]", " ")
    tokens = F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), undo_lookalikes)
    df = df.withColumn("_n", F.array_join(tokens, " ")).withColumn("_n", drop_honorifics(F.col("_n")))
    variants = literal_map(VARIANTS)
    tokens = F.transform(F.filter(F.split(F.col("_n"), " "), lambda t: t != ""), lambda t: F.coalesce(F.element_at(variants, t), t))
    text = F.array_join(F.transform(tokens, legal_token), " ")
    for pattern, form in LEGAL_PHRASES:
        text = F.regexp_replace(text, pattern, form)
    df = df.withColumn("_t", F.filter(F.split(text, " "), lambda t: t != ""))
    df = df.withColumn("_body", F.filter("_t", lambda t: ~t.isin(FORMS))).withColumn("_legal", F.array_distinct(F.filter("_t", lambda t: t.isin(FORMS))))
    df = df.withColumn(out, F.array_join(F.concat("_body", "_legal"), " "))
    if core:
        df = df.withColumn(core, F.array_join(F.when(F.size("_body") > 0, F.col("_body")).otherwise(F.col("_t")), " "))
    return df.drop("_n", "_t", "_body", "_legal")


def legal_forms(name: Column) -> Column:
    """The legal forms of a standardized name, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(name, " "), lambda t: t.isin(FORMS))))


def vote_words(pairs: DataFrame, left: str, right: str, least: int = 2) -> DataFrame:
    """(left_word, right_word, votes): texts of equal token counts vote by position; the majority stays if it has
    enough votes, ties to the smaller word."""
    cut = lambda c: F.filter(F.split(F.col(c), r"[\s,.()&/\-]+"), lambda t: t != "")
    rows = pairs.select(cut(left).alias("a"), cut(right).alias("b")).where((F.size("a") == F.size("b")) & (F.size("a") > 0))
    rows = rows.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("left_word"), F.lower("z.b").alias("right_word"))
    votes = rows.groupBy("left_word", "right_word").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("left_word").orderBy(F.desc("votes"), "right_word")
    return votes.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("votes") >= least)).drop("r")


def learn_word_map(truth: DataFrame, s1: DataFrame, others: DataFrame, least: int = 2) -> DataFrame:
    """Native word -> English word from matched names, of records whose name holds native letters."""
    native = others.where(F.col("business_name").rlike("[\\u0900-\\u0DFF]")).select("entity_id", F.col("business_name").alias("native"))
    english = s1.select(F.col("entity_id").alias("source1_entity_id"), F.col("business_name").alias("english"))
    pairs = truth.join(native, "entity_id").join(english, "source1_entity_id")
    return vote_words(pairs, "native", "english", least).where(F.col("left_word").rlike("[\\u0900-\\u0DFF]"))
