"""License scan by diagonal voting.

All rolling word k-gram hashes of a document are joined to the places of the same k-grams in known
license texts. A hit at word ``p`` of the document and word ``q`` of a template votes for the
diagonal ``p - q``: hits of one occurrence share it. Votes are added by diagonal; where words were
inserted or left out, an occurrence continues on a neighbouring diagonal, so neighbours are merged.
A merged span is accepted when the template's words that its votes cover, equal in the texts and
not only in their hashes, are enough of it. Short phrases must be whole, on one diagonal.

Everything is DataFrame functions. Words never leave the task that reads the document, votes are
combined there, and only diagonals are shuffled.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnwise.session import materialise

#: The phrases that must be reported, with their labels.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Openings of public license texts and notices, as words.
TEXTS = (
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files the software to deal in the software without restriction"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of "
               "the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
            "fee is hereby granted provided that the above copyright notice and this permission notice appear"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words of a gram: for the phrases, and for the longer texts.
PHRASE_GRAM = 2
TEXT_GRAM = 4
#: Diagonals so near belong to one occurrence.
NEIGHBOURS = 4
#: Percent of a text's words that an occurrence must cover.
LEAST_COVER = 80

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A template's words are bits of a long.
_MOST_WORDS = 62
_HEADER = 0


def template_rows() -> list[tuple]:
    """``(template, label, phrase, size, gram, place, w0, w1, w2, w3)`` for each gram of each template."""
    rows = []
    known = [(x, t, True) for x, t in PHRASES] + [(x, t, False) for x, t in TEXTS]
    for number, (label, text, phrase) in enumerate(known, start=1):
        words, gram = text.split(), PHRASE_GRAM if phrase else TEXT_GRAM
        if not gram <= len(words) <= _MOST_WORDS:
            raise ValueError(f"a template needs {gram} to {_MOST_WORDS} words: {text}")
        for place in range(len(words) - gram + 1):
            held = words[place : place + gram] + [None] * (TEXT_GRAM - gram)
            rows.append((number, label, phrase, len(words), gram, place, *held))
    return rows


def _gram(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _templates(spark: SparkSession) -> DataFrame:
    """The grams of all templates, a few hundred rows whatever the data."""
    names = [f"t{i}" for i in range(TEXT_GRAM)]
    grams = spark.createDataFrame(
        template_rows(),
        "template int, label string, phrase boolean, size int, gram int, place int, "
        + ", ".join(f"{n} string" for n in names),
    )
    words = [F.col(n) for n in names]
    key = F.when(F.col("gram") == PHRASE_GRAM, _gram(words[:PHRASE_GRAM])).otherwise(_gram(words))
    header = spark.createDataFrame(
        [(0, None, False, 0, 0, 0, *[None] * TEXT_GRAM)], grams.schema
    ).withColumn("key", F.lit(_HEADER).cast("long"))
    return grams.withColumn("key", key).unionByName(header)


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BREAK), "")


def votes(docs: DataFrame) -> DataFrame:
    """Votes by document and diagonal: ``(row, doc_id, template, ..., diagonal, covered, lo, hi)``.

    ``covered`` has a bit for each word of the template that a vote covers. Template 0 is a row for
    each document, whose diagonal is its number of words. Written once: row numbers belong to the
    one pass that gave them.
    """
    spark = docs.sparkSession
    each = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words")
    )
    # One more element without a word stands for the document itself.
    shifted = [F.expr("array_append(words, cast(null as string))").alias("w0")] + [
        F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}")
        for i in range(1, TEXT_GRAM)
    ]
    placed = each.select("row", "doc_id", *shifted).select(
        "row", "doc_id", F.posexplode(F.arrays_zip(*(f"w{i}" for i in range(TEXT_GRAM)))).alias("at", "w")
    )
    words = [F.col(f"w{i}") for i in range(TEXT_GRAM)]
    grams = placed.select("row", "doc_id", "at", "w.*").select(
        "*",
        F.explode(
            F.when(F.col("w0").isNull(), F.array(F.lit(_HEADER).cast("long"))).otherwise(
                F.array(_gram(words[:PHRASE_GRAM]), _gram(words))
            )
        ).alias("key"),
    )
    equal = [
        (F.col(f"w{i}") == F.col(f"t{i}")) | (F.col("gram") <= i) for i in range(1, TEXT_GRAM)
    ]
    hits = grams.join(F.broadcast(_templates(spark)), "key").where(
        F.col("w0").eqNullSafe(F.col("t0")) & equal[0] & equal[1] & equal[2]
    )
    bits = F.expr("shiftleft(shiftleft(1L, gram) - 1, place)")
    voted = hits.groupBy(
        "row", "doc_id", "template", "label", "phrase", "size",
        (F.col("at") - F.col("place")).cast("long").alias("diagonal"),
    ).agg(
        F.bit_or(bits).alias("covered"),
        F.min("at").alias("lo"),
        F.max(F.col("at") + F.col("gram") - 1).alias("hi"),
    )
    return materialise(voted)


def _covered(bits: Column) -> Column:
    return F.bit_count(bits)


def spans(voted: DataFrame) -> DataFrame:
    """Accepted places: ``(row, doc_id, label, phrase, first, last, cover, size)``, in words from 0.

    Phrases are taken diagonal by diagonal. The votes of a longer text are merged along
    neighbouring diagonals, in an order within one document and template; a document's own words
    bound that group. A merged span must cover enough of the text and be at most twice its length.
    """
    phrases = voted.where(F.col("phrase") & (_covered(F.col("covered")) == F.col("size"))).select(
        "row", "doc_id", "label", "phrase", F.col("diagonal").alias("first"),
        (F.col("diagonal") + F.col("size") - 1).alias("last"),
        F.col("size").alias("cover"), "size",
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.coalesce(
        F.col("diagonal") - F.lag("diagonal").over(near) > NEIGHBOURS, F.lit(True)
    ).cast("int")
    merged = (
        voted.where(~F.col("phrase") & (F.col("template") > 0))
        .withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(near))
        .groupBy("row", "doc_id", "template", "label", "phrase", "size", "run")
        .agg(
            F.bit_or("covered").alias("covered"),
            F.min("lo").cast("long").alias("first"), F.max("hi").cast("long").alias("last"),
        )
        .withColumn("cover", _covered(F.col("covered")))
    )
    whole = (F.col("cover") * 100 >= F.col("size") * LEAST_COVER) & (
        F.col("last") - F.col("first") < 2 * F.col("size")
    )
    return phrases.unionByName(merged.where(whole).select(phrases.columns))


def query(docs: DataFrame) -> DataFrame:
    """What licenses each document names: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    ``score`` is the best of a document's places: words covered over the template's words and one,
    so a longer text counts for more than a phrase; zero without a place. NULL and empty texts have
    no words. Documents that share an id, repeated rows and rows without an id stay rows of their
    own. Very long texts are whole: their votes are added like any other's. An empty table gives an
    empty result.
    """
    voted = votes(docs)
    places = spans(voted)
    base = F.col("phrase")
    rows = voted.where("template = 0").select(
        "row", "doc_id", F.col("diagonal").alias("n_words"), F.lit(None).cast("boolean").alias("phrase"),
        *(F.lit(None).cast(t).alias(c) for c, t in
          (("label", "string"), ("first", "long"), ("cover", "int"), ("size", "int"))),
    )
    found = places.select(
        "row", "doc_id", F.lit(None).cast("long").alias("n_words"), "phrase", "label", "first", "cover", "size"
    )

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")

    return (
        rows.unionByName(found)
        .groupBy("row", "doc_id")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max(F.col("cover") / (F.col("size") + 1)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def _values() -> str:
    def literal(value) -> str:
        if value is None:
            return "null"
        return f"'{value}'" if isinstance(value, str) else str(value).lower()

    return ",\n".join("(" + ", ".join(map(literal, row)) + ")" for row in template_rows())


SQL = f"""
    with templates(template, label, phrase, size, gram, place, t0, t1, t2, t3) as (values
        {_values()}),
    docs as (
        select row_number() over () as rid, doc_id,
            list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words
        from documents),
    each as (select rid, unnest(words) as w0, generate_subscripts(words, 1) - 1 as place from docs),
    grams as (
        select rid, place as pos, w0, lead(w0, 1) over z as w1, lead(w0, 2) over z as w2,
            lead(w0, 3) over z as w3
        from each window z as (partition by rid order by place)),
    voted as (
        select rid, template, label, phrase, size, pos - place as diagonal,
            bit_or(((1::bigint << gram) - 1) << place) as covered, min(pos) as lo, max(pos + gram - 1) as hi
        from grams join templates
            on w0 = t0 and w1 = t1 and (gram = 2 or (w2 = t2 and w3 = t3))
        group by all),
    marked as (
        select *, coalesce(diagonal - lag(diagonal) over z > {NEIGHBOURS}, true) as opens
        from voted where not phrase window z as (partition by rid, template order by diagonal)),
    runs as (
        select *, sum(opens::int) over (partition by rid, template order by diagonal) as run from marked),
    places as (
        select rid, label, true as phrase, diagonal as start, size::int as cover, size
        from voted where phrase and bit_count(covered) = size
        union all
        select rid, label, false, min(lo), bit_count(bit_or(covered))::int, size
        from runs group by rid, template, label, size, run
        having bit_count(bit_or(covered))::int * 100 >= size * {LEAST_COVER} and max(hi) - min(lo) < 2 * size)
    select d.doc_id, len(any_value(d.words)) as n_words, count(*) filter (where phrase) as n_base,
        min(start) filter (where phrase) as first_word, max(start) filter (where phrase) as last_word,
        coalesce(string_agg(distinct label, ',' order by label) filter (where phrase), '') as base_labels,
        coalesce(string_agg(distinct label, ',' order by label), '') as labels,
        coalesce(max(cover / (size + 1)), 0.0)::double as score
    from docs d left join places p on p.rid = d.rid group by d.rid, d.doc_id
"""
