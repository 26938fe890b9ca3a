"""Contracts and validation rules: the first broken rule is the reason, and rows part into valid ones and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import contains_any, let, word_count

LEAST_TITLE, LEAST_CONTENT, LEAST_WORDS, LEAST_SUMMARY_WORDS, LEAST_RELEVANCE = 10, 1000, 50, 20, 0.05
#: Titles outside the editorial scope, openings of newsletters, injected instructions and what excuses them.
TITLE_BLOCKS = (
    r"The Download:.*",
    r"(?i)(big spring sale|prime day|black friday|cyber monday|% off|deal:|best deals|deal of the day|price drop|coupon|voucher|discount code|shopping guide|gift guide|affiliate picks?)",
    r"(?i)(best .+ to buy|buying guide|vs\.\s)",
    r"(?i)(election results|election campaign|campaign trail|candidate debate|presidential race|parliamentary election|midterm results?)",
    r"(?i)(travel guide|flight deal|hotel deal|packing list|fashion week|red carpet|celebrity style|beauty routine|outfit ideas|dating tips?)",
    r"(?i)(named.*fellow|honorary degree|commencement address|class of \d{4}|admitted to the|divestment resolution|AAAS fellow)",
    r"(?i)(is hiring|is laying off|raises \$\d+[MB]|funding round|series [A-D]\b)",
    r"(?i)^STAT\+:",
)
NEWSLETTER = (r"(?i)today's edition of", r"(?i)weekday newsletter", r"(?i)daily dose of", r"(?i)top stories")
INJECTION = (
    r"(?iu)\bignore\s+(?:previous|all|the|prior)\s+instructions\b",
    r"(?iu)\bignora\s+(?:las\s+)?(?:instrucciones|órdenes)\s+(?:anteriores|previas)\b",
    r"(?iu)\bforget\s+(?:my\s+)?(?:previous|all|prior)\s+instructions\b",
    r"(?iu)\bolvida\s+(?:las\s+)?(?:instrucciones|reglas)\s+(?:anteriores|previas)\b",
    r"(?iu)\bsystem\s+prompt\b",
    r"(?iu)\bprompt\s+del\s+sistema\b",
    r"(?iu)\bstop\s+translating\b",
    r"(?iu)\bdeja\s+de\s+traducir\b",
    r"(?iu)\bno\s+traduzcas\b",
    r"(?iu)\bignore\s+the\s+text\s+(?:above|below)\b",
    r"(?iu)\bignora\s+el\s+texto\s+(?:de\s+)?(?:arriba|abajo)\b",
    r"(?iu)\bnew\s+instruction\b",
    r"(?iu)\bnueva\s+instrucción\b",
    r"(?iu)\[system\b",
    r"(?iu)\[instruction\b",
)
EXCUSES = (
    "prompt injection", "inyección de prompt", "inyección indirecta", "jailbreak", "jailbreaking", "cybersecurity", "ciberseguridad", "security vulnerability",
    "vulnerabilidad de seguridad", "security researcher", "investigador de seguridad", "investigadores de seguridad", "threat intelligence",
    "inteligencia de amenazas", "google threat intelligence", "red team", "equipo rojo", "vulnerabilities", "vulnerabilidades", "common crawl", "adversarial",
    "adversario", "ciberataque", "cyberattack", "google security", "security blog", "investigador", "investigadores",
)


def admission_reason(title: Column, content: Column, mode: Column, least: int = LEAST_CONTENT) -> Column:
    short_title = F.length(F.trim(F.coalesce(title, F.lit("")))) < LEAST_TITLE
    short_text = ~mode.eqNullSafe("summary_only") & (F.length(F.coalesce(content, F.lit(""))) < least)
    return F.when(short_title, "title_too_short").when(short_text, "content_too_short")


def few_words(text: Column, summary_mode: Column) -> Column:
    least = F.when(summary_mode, LEAST_SUMMARY_WORDS).otherwise(LEAST_WORDS)
    return F.when(word_count(text) < least, "too_few_words")


def off_title(title: Column, body: Column, summary_mode: Column | None = None, least: float = LEAST_RELEVANCE) -> Column:
    """Too few of the title's longer words, letters of any language, occur in the body; summaries and empty texts are not judged."""
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: F.length(w) > 3)
    judged = (F.coalesce(body, F.lit("")) != "") & ~F.coalesce(summary_mode if summary_mode is not None else F.lit(False), F.lit(False))

    def off(t: Column) -> Column:
        found = F.filter(t["words"], lambda w: F.contains(t["low"], w))
        return (F.size(t["words"]) > 0) & (F.size(found) / F.greatest(F.size(t["words"]), F.lit(1)) < least)

    # else the body would be put into lower case for each word
    return F.when(judged & let(F.struct(words.alias("words"), F.lower(F.coalesce(body, F.lit(""))).alias("low")), off), "title_not_in_body")


def matches_any(text: Column, patterns: tuple[str, ...], reason: str) -> Column:
    """The reason where one of the patterns matches, or null: one pattern, so the text is made and read once."""
    return F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), reason)


def injected(text: Column) -> Column:
    """Instructions to a model in a text that does not write about such attacks."""
    found = lambda t: matches_any(t, INJECTION, "prompt_injection")
    return let(text, lambda t: F.when(found(t).isNotNull() & ~let(F.lower(t), lambda low: contains_any(low, EXCUSES)), "prompt_injection"))


def first_reason(title: Column, content: Column, summary_mode: Column, summary: Column | None = None) -> Column:
    """The first broken rule of the chain, or null. Words are counted in the content, or in the summary where there is none."""
    summary = F.lit(None).cast("string") if summary is None else summary
    text = F.coalesce(F.when(content != "", content), summary)
    return F.coalesce(
        few_words(text, summary_mode), off_title(title, content, summary_mode), matches_any(title, TITLE_BLOCKS, "blocked_title"),
        matches_any(F.substring(content, 1, 1000), NEWSLETTER, "newsletter"), injected(F.concat_ws("\n", title, content, summary)),
    )


def failure_text(rule: Column, reason: Column) -> Column:
    """What is noted of a rejected article."""
    return F.concat(F.lit("Validation failed: "), rule, F.lit(" - "), reason)


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rejects with it)."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
