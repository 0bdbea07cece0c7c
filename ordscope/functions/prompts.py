"""Prompt texts from fixed templates and nouns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.ids import case_map, split_marker
from ordscope.functions.literals import map_of


def _noun_map() -> Column:
    """Literal map ``language|group`` to noun; constant-folded, so looked up, not branched."""
    nouns = {f"en|{g[0]}": g[0] for g in fv.GROUPS}
    nouns |= {f"es|{g[0]}": g[1] for g in fv.GROUPS}
    nouns |= {f"pt-BR|{g[0]}": g[2] for g in fv.GROUPS}
    for language, words in fv.INDIGENOUS_NOUNS.items():
        nouns |= {f"{language}|{grp}": noun for grp, noun in words.items()}
    return map_of(nouns)


def english_article(noun: Column) -> Column:
    """``'an '`` before a vowel letter unless the word starts with a consonant sound."""
    lower = F.lower(noun)
    sounds = "^(" + "|".join(fv.CONSONANT_SOUND_PREFIXES) + ")"
    return F.when(lower.rlike("^[aeiou]") & ~lower.rlike(sounds), F.lit("an ")).otherwise(F.lit("a "))


def noun_for(group: Column, language: Column) -> Column:
    """Noun of a group in a language; NULL when none is documented."""
    family = F.when(language.startswith("es"), F.lit("es")).otherwise(language)
    return F.try_element_at(_noun_map(), F.concat_ws("|", family, group))


def _template_parts() -> tuple[dict[str, str], dict[str, str]]:
    """Text before the article, and the article with its separator, per language."""
    heads, articles = {}, {}
    for language, template in fv.PROMPT_TEMPLATES.items():
        head, rest = template.split("{article}")
        heads[language] = head
        articles[language] = fv.ARTICLES.get(language, "") + rest.split("{noun}")[0]
    return heads, articles


def prompt_text(group_key: Column, language: Column) -> Column:
    """Prompt of a (possibly marker-encoded) group key; NULL when unavailable."""
    split = split_marker(group_key)
    marker = split["marker"]
    adjective = F.when(marker.isNull(), F.lit("")).otherwise(case_map(marker, fv.MARKERS))
    allowed = marker.isNull() | (language == "en")
    spoken = F.when(allowed, F.concat(adjective, noun_for(split["grp"], language)))
    heads, articles = _template_parts()
    article = F.when(language == "en", english_article(spoken)).otherwise(case_map(language, articles))
    return F.when(language.isin(*fv.INDIGENOUS_LANGUAGES), spoken).otherwise(
        F.concat(case_map(language, heads), article, spoken)
    )


def prompt_status(group_key: Column, language: Column) -> Column:
    """``ok`` or the reason why no prompt can be rendered."""
    split = split_marker(group_key)
    marker, group = split["marker"], split["grp"]
    languages = [*fv.PROMPT_TEMPLATES, *fv.INDIGENOUS_LANGUAGES]
    return (
        F.when(
            marker.isNotNull() & (language != "en"),
            F.concat(
                F.lit("unavailable:NotImplementedError:marker prompts are English-only: "), language
            ),
        )
        .when(
            marker.isNotNull() & ~marker.isin(*fv.MARKERS),
            F.concat(F.lit("unavailable:KeyError:unknown marker "), marker),
        )
        .when(
            ~language.isin(*languages),
            F.concat(F.lit("unavailable:ValueError:unknown language "), language),
        )
        .when(
            ~group.isin(*fv.GROUP_NAMES),
            F.concat(F.lit("unavailable:KeyError:unknown group "), group),
        )
        .when(
            noun_for(group, language).isNull(),
            F.concat(F.lit("unavailable:ValueError:no documented "), language, F.lit(" noun for "), group),
        )
        .otherwise(F.lit("ok"))
    )
