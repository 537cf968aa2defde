"""License scan with ordered signature rules, in DataFrame functions only.

Every rule has a regular expression over the words of a text, a keyword, a hint, a priority and a
confidence. A text is looked at only by rules whose keyword it has (an equi-join with the rule table,
whose size is fixed) and whose hint it has; both are words that every match of the expression has. Of
overlapping detections, one that lies within another is suppressed; of equal ones the rule of higher
priority stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm import text as tx

#: Phrases that are always reported, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, hint, expression of the name. Order is priority: more specific names come first. Every match of the
#: expression has the words of the hint; a word with a star may have a number directly behind it.
NAMES = (
    ("agpl-3", "affero general", r"(?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)?(?: v3| version 3)?(?: 0)?"),
    ("agpl-3", "agpl*", r"(?:gnu )?agpl ?(?:v?3)?(?: 0)?(?: only| or later)?"),
    ("lgpl-3", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?: v| version)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?: v| version)? ?2 1"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2", "library general", r"(?:gnu )?library general public licen[cs]e(?: version 2)?"),
    ("lgpl-3", "lgpl*", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl*", r"(?:gnu )?lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[cs]e(?: v| version)? ?3(?: 0)?(?: or later)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[cs]e(?: v| version)? ?2(?: 0)?(?: or later)?"),
    ("gpl-1", "general public", r"(?:gnu )?general public licen[cs]e(?: v| version)? ?1(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-3", "gpl*", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl*", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    ("apache-2", "apache*", r"apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?2(?: 0)?(?: licen[cs]e)?"),
    ("apache-1.1", "apache*", r"apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?1 1"),
    ("apache-1", "apache*", r"apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?1 0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("mit", "mit", r"mit(?: x11| expat)?(?: style)? licen[cs]e"),
    ("mit", "mit", r"mit"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)?(?: licen[cs]e)?"),
    ("isc", "isc", r"isc(?: licen[cs]e)?"),
    ("mpl-2", "mozilla public", r"mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla public", r"mozilla public licen[cs]e(?: v| version)? ?1 1"),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e"),
    ("mpl-2", "mpl*", r"mpl ?v?2(?: 0)?"),
    ("epl-2", "eclipse public", r"eclipse public licen[cs]e(?: v| version)? ?2(?: 0)?"),
    ("epl-1", "eclipse public", r"eclipse public licen[cs]e(?: v| version)? ?1(?: 0)?"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e"),
    ("cddl", "cddl*", r"cddl(?: ?v?1 [01])?"),
    ("cddl", "development and distribution", r"common development and distribution licen[cs]e(?: version 1 [01])?"),
    ("eupl", "european union", r"european union public licen[cs]e(?: v?1 [012])?"),
    ("cpl-1", "common public", r"common public licen[cs]e(?: version 1 0)?"),
    ("artistic-2", "artistic", r"artistic licen[cs]e ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)?(?: licen[cs]e)?"),
    ("boost-1", "boost software", r"boost software licen[cs]e(?: version 1 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2", "python", r"(?:python software foundation|python) licen[cs]e(?: version 2)?"),
    ("python-2", "psf", r"psf licen[cs]e(?: version 2)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("php-3", "php", r"php licen[cs]e(?: version 3 0[01]?)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("ofl-1.1", "sil open font", r"sil open font licen[cs]e(?: version 1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("odbl", "open database", r"open database licen[cs]e"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons", r"creative commons (?:cc )?zero(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1234] 0)?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1234] 0)?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1234] 0)?"),
    ("cc-by", "cc by", r"cc by(?: [1234] 0)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] 0)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1234] 0)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1234] 0)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] 0)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] 0)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1234] 0)?"),
    ("creative-commons", "creative commons", r"creative commons"),
)

#: How a name is spoken of: keyword (none beside the name's hint), expression around it, confidence.
FORMS = (
    ("licensed", "(?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of (?:the )?)?(?:a )?{}(?: licen[cs]e)?", 0.95),
    ("released", "(?:is |are )?released under (?:the )?(?:terms of (?:the )?)?(?:a )?{}(?: licen[cs]e)?", 0.95),
    ("distributed", "(?:is |are )?distributed under (?:the )?(?:terms of (?:the )?)?(?:a )?{}(?: licen[cs]e)?", 0.95),
    ("spdx", "spdx licen[cs]e identifier {}", 1.0),
    (None, "(?:licen[cs]e )?{}", 0.7),
)

#: label, keyword, hint, expression of wording, confidence. Every match has the words of the keyword and of the hint.
WORDINGS = (
    ("mit", "permission", "charge", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "permission", "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", 1.0),
    ("bsd", "redistribution", "binary", "redistribution and use in source and binary forms with or without modification(?: are permitted)?", 1.0),
    ("bsd-3-clause", "endorse", "products", "may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "advertising", "display", "all advertising materials mentioning features or use of this software must display", 0.9),
    ("gpl", "redistribute", "general public", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", "redistribute", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    ("gpl", "warranty", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    ("apache-2", "compliance", "license", "you may not use this file except in compliance with the license", 0.9),
    ("mpl", "subject", "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("zlib", "provided", "express", "this software is provided as is without any express or implied warranty", 0.8),
    ("boost-1", "boost", "software", "boost software license version 1 0", 0.9),
    ("unlicense", "unencumbered", "domain", "this is free and unencumbered software released into the public domain", 1.0),
    ("public-domain", "public", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "domain", "public", "public domain", 0.5),
    ("proprietary", "rights", "reserved", "all rights reserved", 0.6),
    ("proprietary", "proprietary", "confidential", "proprietary and confidential", 0.8),
    ("proprietary", "reproduction", "prohibited", "(?:unauthori[sz]ed )?reproduction (?:or distribution )?is (?:strictly )?prohibited", 0.6),
    ("cc0", "waived", "copyright", "has waived all copyright and related or neighboring rights", 0.9),
    ("cc-by-sa", "text", "commons", "text is available under the creative commons attribution share ?alike licen[cs]e", 0.95),
    ("ofl-1.1", "font", "reserved", "reserved font name", 0.5),
    ("commercial", "commercial", "required", "commercial licen[cs]e (?:is )?required", 0.7),
    ("non-commercial", "use", "only", "(?:for )?non ?commercial use only", 0.7),
    ("research-only", "research", "purposes", "(?:for )?research purposes only", 0.6),
    ("no-ai", "used", "models", "may not be used (?:for|to) train(?:ing)?(?: of)? (?:ai|machine learning|language) models", 0.8),
)


def rules() -> list[tuple[int, str, str, str, str, float]]:
    """(priority, label, keyword, hint, expression, confidence), the highest priority first.

    The keyword and the hint are pieces of a text of spaced words without which the expression matches nothing.
    """
    out = [(label, keyword, hint, body, sure) for label, keyword, hint, body, sure in WORDINGS]
    for keyword, form, sure in FORMS:
        for label, hint, name in NAMES:
            if name == "mit" and keyword is None:
                continue  # A plain word of some languages.
            out.append((label, keyword or hint, hint, form.format(f"(?:{name})"), sure))
    return [(k, label, _gate(keyword), _gate(hint), _words_pattern(body), sure)
            for k, (label, keyword, hint, body, sure) in enumerate(out)]


def _gate(hint: str) -> str:
    """What a text of spaced words contains if it has the words of the hint."""
    spaced = f" {hint.replace(' ', '  ')} "
    return spaced.replace("* ", "")


def _words_pattern(body: str) -> str:
    """The expression over a text whose words each have a space before and behind."""
    body = body.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    return f" (?:{body}) "


def spread(text: Column) -> Column:
    """The words in lower case, each with a space before and behind; without words two spaces."""
    lower = F.translate(F.coalesce(text, F.lit("")), tx.ASCII_UPPER, tx.ASCII_LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")),
                    F.lit(" "))


def _count(words: Column) -> Column:
    return ((F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(spread_words: Column, n_words: Column) -> dict[str, Column]:
    found, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in BASE:
        wrapped = f" {phrase.replace(' ', '  ')} "
        size = len(phrase.split())
        has = F.contains(spread_words, F.lit(wrapped))
        bare = F.replace(spread_words, F.lit(wrapped), F.lit(""))
        found = found + F.when(has, ((F.length(spread_words) - F.length(bare)) / len(wrapped)).cast("long")) \
            .otherwise(0)
        before = F.substring_index(spread_words, wrapped, 1)
        firsts.append(F.when(has, _count(before)))
        lasts.append(F.when(has, n_words - _count(F.substring_index(spread_words, wrapped, -1)) - size))
        labels.append(F.when(has, F.lit(label)))
    return {"n_base": found, "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
            "base": F.array_compact(F.array(*labels))}


#: A row is known by its id and by two sums of its words, so rows of one id, or of none, stay apart.
KEY = ("doc_id", "one", "two")


def _worded(texts: DataFrame) -> DataFrame:
    words = texts.select("doc_id", spread(F.col("text")).alias("words"))
    return words.select("doc_id", F.xxhash64("words").alias("one"), F.xxhash64(F.lit(1), "words").alias("two"), "words")


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, label, rule, start, end (words, end exclusive), confidence of what is not suppressed.

    Rows with an equal id and equal words are one.
    """
    return _detected(_worded(docs)).drop("one", "two")


def _detected(words: DataFrame) -> DataFrame:
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(
        rules(), "rule int, label string, keyword string, hint string, pattern string, confidence double"))
    keywords = F.array(*[F.lit(k) for k in sorted({k for _, _, k, _, _, _ in rules()})])
    # The outer form, so that no filter repeats the work on the text below the join.
    keyed = words.select(*KEY, "words", F.explode_outer(
        F.filter(keywords, lambda k: F.contains(F.col("words"), k))).alias("keyword"))
    hit = keyed.join(table, "keyword").where(F.contains("words", "hint")).select(
        *KEY, "rule", "label", "confidence", F.regexp_extract_all("words", "pattern", F.lit(0)).alias("hits"),
        F.when(F.regexp_like("words", "pattern"), F.split("words", F.col("pattern"), F.lit(-1))).alias("gaps")) \
        .where("size(hits) > 0")
    each = hit.select(*KEY, "rule", "label", "confidence", F.posexplode(
        F.arrays_zip("hits", F.slice("gaps", F.lit(1), F.size("hits"))))).select(
        *KEY, "rule", "label", "confidence", "pos", _count(F.col("col.hits")).alias("size"),
        _count(F.col("col.1")).alias("gap"))
    order = Window.partitionBy(*KEY, "rule").orderBy("pos")
    placed = each.distinct().withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)) \
        .withColumn("start", F.col("end") - F.col("size"))
    outer = Window.partitionBy(*KEY).orderBy("start", F.desc("end"), "rule") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("reach", F.max("end").over(outer)) \
        .where("reach IS NULL OR reach < end").select(*KEY, "label", "rule", "start", "end", "confidence")


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels. The score is the highest confidence of a
    detection, 1 with a base phrase and 0 without any detection. Rows that repeat an id, and rows
    without one, are judged by their own text each. An empty table gives no rows.
    """
    words = _worded(tx.plain(docs))
    counted = words.select(*KEY, "words", _count(F.col("words")).alias("spaces"))
    counted = counted.select(*KEY, "words", F.when(F.col("words") == "  ", F.lit(0).cast("long"))
                             .otherwise(F.col("spaces")).alias("n_words"))
    base = counted.select(*KEY, "n_words", *[c.alias(n) for n, c in _base(
        F.col("words"), F.col("n_words")).items()])
    more = _detected(words).groupBy(*KEY).agg(
        F.collect_set("label").alias("more"), F.max("confidence").alias("confidence"))
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base.join(more, list(KEY), "left").select(
        tx.given_id(), "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"), F.concat_ws(",", both).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("score"))
