"""Defective question and answer pairs (problem 5).

Distinct answers are sorted by text; a shortened version of another answer is then a proper prefix of its neighbour. The words
of all answers are sorted likewise: an answer that ends in the beginning of a neighbouring word, itself hardly ever a whole
word, was cut inside it. Lengths that hold far more unfinished answers than their surroundings are taken as limits. Rules for
empty, refused, copied and foreign-language answers come first, as each answer has one defect at most; rules for open structure
and long unfinished answers come after the neighbours and limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import BLANK, not_blank
from heddle.session import stage

#: The names of roles, after cleaning.
USER, ASSISTANT = ("user", "human", "customer", "prompter"), ("assistant", "gpt", "bot", "model", "ai", "chatbot", "chatgpt")

#: Our choice: answers that stand for no answer, after removing case, brackets and punctuation.
PLACEHOLDERS = ("", "none", "null", "nan", "n a", "na", "no output", "no answer", "no response", "empty", "empty response", "empty answer", "blank", "tbd", "todo", "undefined", "nil", "missing", "not available", "keine antwort", "aucune réponse", "sin respuesta", "无", "空", "leer", "vide", "vacío")

#: Our choice: how answers begin that decline or claim inability, in the languages of the corpus.
REFUSALS = (
    r"^(?:(?:i am|i'm|i) (?:\w+ )?sorry|sorry|my apologies|apologies|i apologi[sz]e|unfortunately|regrettably|as an (?:ai|assistant|a language)|as a (?:language|large)|i'm (?:unable|not able|afraid|not allowed)|it(?:'s| is) not possible for me|my (?:guidelines|instructions|policy|rules)\b|this is not something i can|i (?:can ?not|can't|cannot|am unable|am not able|'m unable|'m not able|won't|will not|must decline|have to decline|do not have|don't have|am afraid|'m afraid|would rather not|refuse|decline))\b",
    r"^(?:es tut mir leid|tut mir leid|entschuldigung|leider|als (?:ki|assistent|sprachmodell)|ich kann (?:\w+ ){0,6}nicht|ich (?:darf|möchte|werde) (?:\w+ ){0,6}nicht|ich bin nicht in der lage|es ist mir nicht|mir ist es nicht|meine (?:richtlinien|vorgaben|regeln))",
    r"^(?:je suis désolée?|désolée?|malheureusement|en tant qu|je ne (?:peux|puis|suis|saurais)|je refuse|il m'est impossible|il ne m'est pas|mes (?:consignes|règles|directives|instructions))",
    r"^(?:lo siento|lamentablemente|desafortunadamente|como (?:asistente|ia|modelo)|no puedo|no me es posible|no estoy en condiciones|me temo que no|perdón|mis (?:directrices|normas|instrucciones|reglas)|me es imposible)",
    r"^(?:抱歉|对不起|很抱歉|很遗憾|不好意思|作为(?:一个|一名)?(?:ai|人工智能|助手|语言模型)|我(?:无法|不能|没办法)|无法|我的(?:准则|规则|指南))",
)
#: Our choice: words that show what an answer declines or cannot do.
INABILITY = r"(?:\bcan(?:no|')t\b|\bcannot\b|\bcan not\b|\bunable\b|\bnot able\b|\bwon't\b|\bwill not\b|\bnot possible\b|\bimpossible\b|\bdo not let\b|\bdon't let\b|\bnot allow|\bdecline\b|\brefuse\b|\bguidelines\b|\bnicht\b|\bunmöglich\b|\bne (?:peux|puis|suis|permet)|\bpas\b|\bimpossible\b|\bno (?:puedo|me|es)\b|\bimposible\b|不能|无法|不可以|没办法|不允许|不便|i'm sorry|i am sorry|désolé|lo siento|tut mir leid|抱歉)"

#: Our choice: frequent words of each language that the others lack.
COMMON = {
    "en": "the is are was with and what does how many people stand in front of which object near yes it he she then there under describe happens between where colour please",
    "de": "der die das den dem und ist sind mit auf hat welche welcher farbe vor hinter unter neben passiert was ein eine einen beschreibe bitte zwischen sekunde zu sehen",
    "fr": "le la les des est et sur dans du une un avec de quelle couleur que se passe sous derrière devant décris ce l'on voit entre seconde puis ensuite à",
    "es": "el la los las es y en del una un con de qué color pasa sobre detrás delante describe lo que se ve entre segundo después al cuál",
}
#: Our choice: how a question names the language it wants.
ASKED = {"en": r"\b(?:in english|auf englisch|en anglais|en inglés)\b|用英[语文]", "de": r"\b(?:in german|auf deutsch|en allemand|en alemán)\b|用德[语文]", "fr": r"\b(?:in french|auf französisch|en français|en francés)\b|用法[语文]", "es": r"\b(?:in spanish|auf spanisch|en espagnol|en español)\b|用西班牙[语文]", "zh": r"\b(?:in chinese|auf chinesisch|en chinois|en chino|in mandarin)\b|用[中汉][语文]"}

#: Our choice: words that introduce a repeated question.
LABELS = ("question", "q", "frage", "pregunta", "user", "prompt", "问题", "问")

TERMINAL = r"[.!?。！？…][\"'”’»)\]]*$"


def role_of(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.when(x.isin(*USER), "user").when(x.isin(*ASSISTANT), "assistant").when(x.isNotNull(), "other")


def spoken(c: Column) -> Column:
    """The answer itself: what stands inside ``answer``, else the text without closed ``think`` parts."""
    inner = F.regexp_extract(c, r"(?s)<answer>(.*?)(?:</answer>|$)", 1)
    return F.when(c.contains("<answer>"), inner).otherwise(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def bare(c: Column) -> Column:
    """Lower-case words with single blanks, for comparing."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"<[^<>]*>", " "), r"[^\p{L}\p{N}]+", " "))


def language(words: Column, text: Column) -> Column:
    """The language with most of its frequent words; zh by script; null if none has two more than the next or text is short."""

    def of(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known)))

    hits = [F.struct(of(v.split()).alias("n"), F.lit(k).alias("lang")) for k, v in COMMON.items()]
    top = F.reverse(F.array_sort(F.array(*hits)))
    clear = F.when((top[0]["n"] >= 2) & (top[0]["n"] > top[1]["n"]), top[0]["lang"])
    return F.when(F.regexp_count(text, F.lit(r"[一-鿿]")) >= 3, "zh").otherwise(clear)


def pairs(messages: DataFrame) -> DataFrame:
    """``(sample_id, msg_idx, question, content)``: each assistant answer with the user question before it.

    A message stored again counts once, its latest version by ``logged_at``. Tool calls are no answers. Messages without
    sample or index belong to no pair; an answer without a question before it is paired with null.
    """
    latest = messages.where("sample_id is not null and msg_idx is not null").groupBy("sample_id", "msg_idx").agg(F.max(F.struct("logged_at", F.col("role").alias("role"), "content")).alias("m"))
    order = Window.partitionBy("sample_id").orderBy("msg_idx")  # the messages of one sample
    rows = latest.select("sample_id", "msg_idx", role_of(F.col("m.role")).alias("role"), F.col("m.content").alias("content"))
    rows = rows.withColumn("question", F.last(F.when(F.col("role") == "user", F.coalesce("content", F.lit(""))), ignorenulls=True).over(order))
    return rows.where((F.col("role") == "assistant") & ~F.coalesce(F.col("content").rlike(r"<tool_call>"), F.lit(False))).select("sample_id", "msg_idx", "question", "content")


def shortened(texts: DataFrame, column: str = "answer") -> DataFrame:
    """``(answer)`` of the distinct texts that are proper prefixes of another one, found between neighbours in sorted order.

    The range sort splits equal beginnings over tasks. What crosses from one range to the next is decided from the first
    answer of each range, one row a range.
    """
    ranged = texts.select(F.col(column).alias("answer")).where("answer != ''").distinct().repartitionByRange("answer").sortWithinPartitions("answer")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(answers: list, next_to: list, last: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(answers, pa.string()), pa.array(next_to, pa.string()), pa.array(last, pa.bool_())], ["answer", "next_to", "last"])

        first = held = None
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                if held is not None and t.startswith(held):
                    found.append(held)
                first, held = t if first is None else first, t
            if found:
                yield rows(found, [None] * len(found), [False] * len(found))
        if held is not None:
            yield rows([held, first], [None, "first"], [True, False])

    out = stage(ranged.mapInArrow(scan, "answer string, next_to string, last boolean"), "shortened")
    ends = out.where("last or next_to is not null").orderBy("answer").collect()  # two rows a range
    across = [(a.answer,) for a, b in zip(ends, ends[1:]) if b.answer != a.answer and b.answer.startswith(a.answer)]
    inside = out.where("not last and next_to is null").select("answer")
    return inside.unionByName(out.sparkSession.createDataFrame(across, "answer string")).distinct()


def broken_words(answers: DataFrame, *, rare: int = 3, rare_share: float = 3e-6) -> DataFrame:
    """``(last)``: ends of answers that are the beginning of a longer word and hardly ever a word of their own.

    ``answers`` has ``answer``. A word is whole where something else than a letter follows it; hardly ever is fewer than
    ``rare`` times and ``rare_share`` of all words. Words are counted with partial aggregation before they are shuffled.
    """
    words = answers.select(F.explode(F.regexp_extract_all("answer", F.lit(r"(\p{L}+)"), 1)).alias("w"), F.lit(1).alias("c"))
    ends = answers.select(F.regexp_extract("answer", r"(\p{L}+)$", 1).alias("w"), F.lit(-1).alias("c")).where("w != ''")
    counts = words.unionByName(ends).groupBy("w").agg(F.sum("c").alias("whole"), F.count_if(F.col("c") == -1).alias("at_end"))
    counts = stage(counts, "words")
    most = F.greatest(F.lit(rare), F.lit(rare_share * (counts.agg(F.sum("whole")).first()[0] or 0)))
    return counts.where((F.col("whole") < most) & (F.col("at_end") > 0)).join(shortened(counts, "w"), F.col("w") == F.col("answer"), "left_semi").select(F.col("w").alias("last"))


def flag_pairs(messages: DataFrame, *, long_words: int = 7, long_letters: int = 9, usual: int = 5, usual_share: float = 0.0003, neighbours: bool = True, most_words: int = 1_000_000) -> DataFrame:
    """Every pair with its ``defect`` or null: ``(sample_id, msg_idx, question, answer, defect)``.

    The first of empty, refusal, copied, truncated, language that holds. An unfinished answer (no final punctuation) is
    truncated if it is a shortened version of another answer or ends inside a word, without being usual itself, if it has the
    length of a spike, leaves a quote, bracket or tag open, or has ``long_words`` words. Usual is what makes up ``usual_share``
    of all answers and occurs ``usual`` times. ``neighbours=False`` leaves the sorted search out, to measure what it contributes.
    Broken words are broadcast up to ``most_words`` and joined beyond. Answers meet by a 128-bit hash, so their texts are
    shuffled for the sort only. Ties, repeated rows and empty tables need no special case.
    """
    p = pairs(messages).withColumn("answer", F.regexp_replace(spoken(F.coalesce("content", F.lit(""))), rf"^{BLANK}+|{BLANK}+$", ""))
    q = F.coalesce(F.regexp_replace("question", r"(?s)<visual_window>.*?</visual_window>", " "), F.lit(""))
    p = p.withColumn("q", bare(q)).withColumn("a", bare(F.col("answer"))).withColumn("n", F.length("content"))
    p = stage(p.withColumn("unfinished", ~F.col("answer").rlike(TERMINAL)).withColumn("h", F.md5("answer")).withColumn("last", F.when(F.col("unfinished"), F.regexp_extract("answer", r"(\p{L}+)$", 1))), "pairs")

    counts = p.groupBy("h").agg(F.count("*").alias("times"), F.max("unfinished").alias("unfinished"))
    texts = p.select("answer").where(F.lit(neighbours))
    short = shortened(texts).select(F.md5("answer").alias("h"))
    broken = stage(broken_words(texts), "broken-words").withColumn("is_broken", F.lit(True))
    lengths = p.where("unfinished").groupBy("n").agg(F.count("*").alias("c"))
    around = Window.orderBy("n").rangeBetween(-12, 12)  # one row per distinct length of an unfinished answer
    limits = lengths.withColumn("near", (F.sum("c").over(around) - F.col("c")) / 24.0).where((F.col("c") >= 8) & (F.col("c") >= 6 * F.col("near")) & (F.col("n") >= 40)).select("n", F.lit(True).alias("at_limit"))
    # what is unfinished and not usual is a small part of all answers' hashes
    rare = counts.where(F.col("unfinished") & (F.col("times") < max(usual, usual_share * p.count()))).select("h", F.lit(True).alias("is_rare"))
    known = rare.join(short.withColumn("is_short", F.lit(True)), "h", "left")
    p = p.join(known, "h", "left").join(F.broadcast(broken) if broken.limit(most_words + 1).count() <= most_words else broken, "last", "left")
    p = p.join(F.broadcast(limits), "n", "left")  # one row a length that is a spike

    qw, aw = F.split("q", " "), F.split("a", " ")
    qset, aset = F.array_distinct(qw), F.array_distinct(aw)
    both, most = F.size(F.array_intersect(qset, aset)), F.greatest(F.size(qset), F.size(aset))
    new = F.size(F.array_except(F.array_except(aset, qset), F.array(*(F.lit(w) for w in LABELS))))
    asks = F.col("answer").rlike(r"[?？][\"'”’)\]]*$|什么|多少|^请") | (aw[0] == qw[0])
    near = asks & (new == 0) & (F.size(qset) >= 3) & (both / most >= 0.7) & (F.size(aw) <= 2.2 * F.size(qw) + 2)
    inside = (F.length("q") >= 8) & F.col("a").contains(F.col("q")) & (F.length("a") <= 2.2 * F.length("q") + 12)
    alike = asks & (F.length("q") >= 8) & (F.abs(F.length("q") - F.length("a")) <= 0.15 * F.length("q"))
    close = F.when(alike, F.expr("levenshtein(q, a, cast(floor(0.15 * length(q)) as int))") >= 0).otherwise(False)  # -1 over the threshold
    copied = (F.col("q") != "") & ((F.col("a") == F.col("q")) | near | inside | close)

    low = F.lower(F.regexp_replace("answer", "’", "'"))
    refusal = F.lit(False)
    for r in REFUSALS:
        refusal = refusal | low.rlike(r)
    refusal = refusal & low.rlike(INABILITY)

    raw = F.coalesce("content", F.lit(""))
    open_tag = (raw.contains("<think>") & ~raw.contains("</think>")) | raw.rlike(r"</?[a-z_]*$")
    quotes = F.regexp_count("answer", F.lit('"')) % 2 == 1
    open_bracket = F.regexp_count("answer", F.lit(r"\(")) > F.regexp_count("answer", F.lit(r"\)"))
    n_words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    wide = (F.regexp_count("answer", F.lit(r"[一-鿿]")) >= long_letters) & ~F.col("answer").rlike(r"[。！？]$")
    long = (n_words >= long_words) | wide
    cut_short = F.coalesce("is_short", F.lit(False)) & ((n_words >= 3) | (F.length("answer") >= 12))
    cut_inside = F.coalesce(F.col("is_rare") & F.col("is_broken"), F.lit(False)) & (n_words >= 2)
    truncated = open_tag | (F.col("unfinished") & (cut_short | cut_inside | quotes | open_bracket | long | (F.coalesce("at_limit", F.lit(False)) & (n_words >= 4)))) | F.col("answer").rlike(r"(?:\.\.\.|…)$")

    q_lang, a_lang = language(qw, q), language(aw, F.col("answer"))
    asked = F.lit(False)
    for k, r in ASKED.items():
        asked = asked | (F.lower(q).rlike(r) & (a_lang == k))
    wants_other = F.lit(False)
    for r in ASKED.values():
        wants_other = wants_other | F.lower(q).rlike(r)
    differs = F.when(wants_other, ~asked & a_lang.isNotNull()).otherwise(q_lang != a_lang)
    foreign = q_lang.isNotNull() & a_lang.isNotNull() & F.coalesce(differs, F.lit(False))

    empty = ~open_tag & (F.col("a").isin(*PLACEHOLDERS) | ~not_blank(F.col("answer")))
    defect = F.when(empty, "empty").when(refusal, "refusal").when(copied, "copied").when(truncated, "truncated").when(foreign, "language")
    return p.select("sample_id", "msg_idx", "question", "answer", defect.alias("defect"))


def defective_pairs(messages: DataFrame) -> DataFrame:
    """``(sample_id, msg_idx, defect)``."""
    return flag_pairs(messages).where("defect is not null").select("sample_id", "msg_idx", "defect")
