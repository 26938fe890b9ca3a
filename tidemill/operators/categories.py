"""Public categories of articles: a direct name, else a classifier's guess, else the nearest name that is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.operators.catalogue import category_key

#: Public categories and their labels, names of sources that say nothing, and names that stand for a category.
LABELS = {
    "CIENCIA": "Ciencia", "SALUD": "Salud", "TECNOLOGÍA": "Tecnología", "EDITORIAL": "Editorial", "ASTRONOMÍA": "Astronomía", "FÍSICA": "Física", "QUÍMICA": "Química",
    "MATEMÁTICA": "Matemática", "BIOLOGÍA": "Biología", "ARQUEOLOGÍA": "Arqueología",
}
GENERIC = ("", "other", "unknown", "general", "science", "ciencia", "multidisciplinary", "biology", "biologia", "life_science", "life_sciences")
GENERIC_SOURCE = (*GENERIC, "popular_science", "community_science")
NAMES = {
    "SALUD": ("health", "salud", "medicine", "medical", "medicina", "public_health", "salud_publica"),
    "TECNOLOGÍA": (
        "technology", "tecnologia", "tech", "artificial_intelligence", "inteligencia_artificial", "ai", "ia", "software", "engineering", "ingenieria", "digital",
    ),
    "ASTRONOMÍA": ("space", "espacio", "astronomy", "astronomia", "astrophysics", "astrofisica"),
    "FÍSICA": ("physics", "fisica"), "QUÍMICA": ("chemistry", "quimica"), "MATEMÁTICA": ("mathematics", "math", "matematica"),
    "ARQUEOLOGÍA": ("archaeology", "arqueologia", "human_evolution"),
    "EDITORIAL": ("editorial", "opinion", "opinion_piece", "analysis", "analisis", "commentary", "comentario", "policy", "politica"),
    "CIENCIA": ("popular_science", "community_science"),
}
DEFAULT, EDITORIAL = "CIENCIA", "EDITORIAL"


def named(key: Column) -> Column:
    """The category that a key stands for, null if none."""
    pairs = [F.lit(x) for category, names in NAMES.items() for name in names for x in (name, category)]
    return F.element_at(F.create_map(*pairs), key)


def resolve(raw: Column, metadata: Column, guess: Column, first_party: Column) -> Column:
    """(category, method) of an article. raw is its source's name for it, metadata another one that counts where raw says
    nothing; guess is a classifier's category, null if there is none. Editorials are first-party only."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    top, other = category_key(text(raw)), category_key(text(metadata))
    own = F.coalesce(first_party, F.lit(False))
    selected = F.when((text(raw) == "") | (top.isin(*GENERIC_SOURCE) & (text(metadata) != "")), other).otherwise(top)
    allowed = lambda c: F.when((c != EDITORIAL) | own, c)
    direct = F.when(~selected.isin(*GENERIC), allowed(named(selected)))
    guessed = F.when(guess.isin(*LABELS), allowed(guess))
    category = F.coalesce(direct, guessed, allowed(named(selected)), allowed(named(top)), allowed(named(other)), F.lit(DEFAULT))
    method = F.when(direct.isNotNull(), "direct_map").when(guessed.isNotNull(), "classifier").otherwise("fallback")
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), category)
    return F.struct(label.alias("category"), method.alias("method"))


def first_party(url: Column, name: Column, source: Column, hosts: tuple[str, ...], names: tuple[str, ...], sources: tuple[str, ...]) -> Column:
    """Whether an article is the publisher's own, by the host of its source, its id, or a part of its name."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://([^/:?#]+)", 1))
    low = F.lower(F.coalesce(name, F.lit("")))
    found = host.isin(*hosts) | F.coalesce(F.lower(source).isin(*sources), F.lit(False))
    for part in names:
        found = found | F.contains(low, F.lit(part))
    return found
