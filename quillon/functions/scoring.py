"""Scores and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig

#: What marks a query as Serbian or English.
SR_LETTERS = "čćšžđČĆŠŽĐ"
SR_WORDS = (
    "kako sta šta zasto zašto koji koja koje gde kada je su na za sa ili nije ima sam treba moze može radi posle pre bez svi "
    "sve ovo taj ta servis servisi servisa greska greske mreza mreze putanja putanje verzija verzije provera izmena izmene "
    "datoteka fajl fajlovi lozinka dozvole korisnik pretraga upit upiti unos unosi baza brzina memorija kopija nadogradnja "
    "pokretanje gasenje brisanje"
).split()
SR_ENDINGS = ("acija", "acije", "aciju", "anje", "anja", "enje", "enja")
EN_WORDS = (
    "how what why which where when the is are on for with or not has have does do should can after before without all this "
    "that it in of to"
).split()
WORD_EDGES = ".,:;?!()[]\"'"


def relevance(distance: Column, cfg: EngineConfig) -> Column:
    """A stand-in for the cross-encoder: a logistic curve over the distance, rounded like its scores."""
    z = cfg.relevance_slope * (1 - distance) + cfg.relevance_offset
    return F.round(1 / (1 + F.exp(-z)), 4)


def age_days(created: Column, now: Column) -> Column:
    """Days of age; missing and future dates count as new."""
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400.0, F.lit(0.0)))


def rational_decay(days: Column, half_life: float, floor: float) -> Column:
    return F.greatest(1 / (1 + days / half_life), F.lit(floor))


def is_superseded(title: Column) -> Column:
    return title.startswith("[SUPERSEDED] ")


def final_score(rel: Column, corpus: Column, days: Column, superseded: Column, cfg: EngineConfig) -> Column:
    """Relevance with time decay and demotion; the ai corpus decays only in mode ``rational``."""
    demote = F.when(superseded, cfg.demotion).otherwise(1.0)
    home = rational_decay(days, cfg.half_life_days, cfg.decay_floor)
    ai = rational_decay(days, cfg.ai_half_life_days, cfg.ai_decay_floor) if cfg.ai_decay == "rational" else F.lit(1.0)
    score = rel * F.when(corpus == "ai", ai).otherwise(home) * demote
    return F.floor(score * 1e4 + 0.5) / 1e4  # of the binary number, as in SQL; F.round goes by its shortest decimals


def shadow_route(home: Column, ai: Column, cfg: EngineConfig) -> Column:
    """scope/reason of a search over both corpora from the best relevance of each (null: no candidate)."""
    strong, weak, none = F.lit(cfg.accept), F.lit(cfg.reject), F.lit(-1.0)
    h, a = F.coalesce(home, none), F.coalesce(ai, none)
    both = home.isNotNull() & ai.isNotNull()
    close = both & (F.abs(home - ai) < cfg.margin)
    leader = F.when(a > h, "ai").otherwise("homelab")
    dead = lambda c: (c >= cfg.dead_low) & (c < cfg.dead_high)
    return (
        F.when((h < weak) & (a < weak), "none/no_candidate")
        .when((h >= strong) & (a >= strong), "both/both_strong")
        .when((h >= strong) | (a >= strong), F.when(close, "both/margin_tie").otherwise(F.concat(leader, F.lit("/single_strong"))))
        .when(close & dead(h) & dead(a), "both/dead_zone_both")
        .when(close & (h >= weak) & (a >= weak), "both/margin_tie")
        .otherwise(F.concat(leader, F.lit("/single_above_reject")))
    )


def query_language(text: Column) -> Column:
    """sr, en or unknown: a Serbian letter decides, else more words of one language; each word counts once."""
    edges = F.lit(WORD_EDGES)
    words = F.array_distinct(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.lower(F.btrim(w, edges))))
    listed = F.array(*map(F.lit, SR_WORDS))
    ends = lambda w: (F.length(w) >= 6) & F.lit(False) if not SR_ENDINGS else (F.length(w) >= 6) & w.rlike(f"({'|'.join(SR_ENDINGS)})$")
    sr = F.size(F.filter(words, lambda w: F.array_contains(listed, w) | ends(w)))
    en = F.size(F.array_intersect(words, F.array(*map(F.lit, EN_WORDS))))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(text.rlike(f"[{SR_LETTERS}]"), "sr")
        .when(sr > en, "sr").when(en > sr, "en").otherwise("unknown")
    )


def public_url(source: Column) -> Column:
    """The source itself if it is an http or https address with a host, else null."""
    return F.when(source.rlike(r"(?i)^https?://[^/?#]+"), source)


def display_link(source: Column, corpus: Column, id_: Column) -> Column:
    return F.coalesce(public_url(source), F.concat(F.lit("kb://"), corpus, F.lit("/"), id_.cast("string")))
