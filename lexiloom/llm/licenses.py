"""Licence scans by sentence rules.

A text is normalised (lower case, marks at line starts dropped, runs of other characters to one blank), with a bar at
sentence ends and blank lines; a single newline is a blank, so wrapped sentences are whole. Known sentences are found in
order, the longest rule first, and stand for identifiers; ordered licence rules then match sequences of identifiers and
use them up, so a rule for a longer licence goes before one whose sentences it contains. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import text_or_empty, unused_name

_PUBLISHED = r"( as published by the free software foundation)? (either )?"
_GENERAL, _LESSER, _AFFERO = (rf"gnu {kind}general public licen[cs]e" for kind in ("", "(lesser|library) ", "affero "))
#: Identifiers, a word that each of the sentences has, and the normalised sentences they stand for. At one
#: place the first rule that matches counts.
SENTENCES = (
    ("SPDXLINE", "spdx", r"spdx licen[cs]e identifier [a-z0-9 ]+"),
    ("MITGRANT", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITNOTICE", "permission", r"the above copyright notice and this permission notice shall be included"),
    ("ISCGRANT", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("BSDHEAD", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("BSDSOURCE", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("BSDBINARY", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDENDORSE", "endorse", r"neither the name of [a-z0-9 ]*may be used to endorse or promote products"),
    ("ASIS", "provided", r"(software|work|material) is provided ([a-z0-9 ]* )?as is"),
    ("BOOSTGRANT", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("ZLIBGRANT", "permission", r"permission is granted to anyone to use this software for any purpose"),
    ("AGPL1", "affero|agpl", rf"{_AFFERO}{_PUBLISHED}v(ersion)? ?1\b|\bagpl ?v? ?1\b"),
    ("AGPL3LATER", "affero|agpl", rf"{_AFFERO}{_PUBLISHED}v(ersion)? ?3 [a-z0-9 ]*later version"),
    ("AGPL3", "affero|agpl", rf"{_AFFERO}{_PUBLISHED}v(ersion)? ?3\b|\bagpl ?v? ?3\b"),
    ("AGPL", "affero|agpl", rf"{_AFFERO}|\bagpl\b"),
    ("LGPL3LATER", "lgpl|lesser|library", rf"{_LESSER}{_PUBLISHED}v(ersion)? ?3 [a-z0-9 ]*later version"),
    ("LGPL3", "lgpl|lesser|library", rf"{_LESSER}{_PUBLISHED}v(ersion)? ?3\b|\blgpl ?v? ?3\b"),
    ("LGPL21LATER", "lgpl|lesser|library", rf"{_LESSER}{_PUBLISHED}v(ersion)? ?2 1 [a-z0-9 ]*later version"),
    ("LGPL21", "lgpl|lesser|library", rf"{_LESSER}{_PUBLISHED}v(ersion)? ?2 1\b|\blgpl ?v? ?2 1\b"),
    ("LGPL2LATER", "lgpl|lesser|library", rf"{_LESSER}{_PUBLISHED}v(ersion)? ?2 [a-z0-9 ]*later version"),
    ("LGPL2", "lgpl|lesser|library", rf"{_LESSER}{_PUBLISHED}v(ersion)? ?2\b|\blgpl ?v? ?2\b"),
    ("LGPL", "lgpl|lesser|library", rf"{_LESSER}|\blgpl\b"),
    ("GPL3LATER", "gpl|gnu", rf"{_GENERAL}{_PUBLISHED}v(ersion)? ?3 [a-z0-9 ]*later version"),
    ("GPL2LATER", "gpl|gnu", rf"{_GENERAL}{_PUBLISHED}v(ersion)? ?2 [a-z0-9 ]*later version"),
    ("GPL3", "gpl|gnu", rf"{_GENERAL}{_PUBLISHED}v(ersion)? ?3\b|\bgpl ?v? ?3\b"),
    ("GPL2", "gpl|gnu", rf"{_GENERAL}{_PUBLISHED}v(ersion)? ?2\b|\bgpl ?v? ?2\b"),
    ("GPL", "gpl|gnu", rf"{_GENERAL}|\bgpl licen[cs]e"),
    ("LATER", "later", r"any later version"),
    ("APACHE2", "apache", r"apache (software )?licen[cs]e (v|version )?2\b|\bapache ?2 0\b|\bapache ?2 licen[cs]e"),
    ("APACHE11", "apache", r"apache (software )?licen[cs]e (v|version )?1 1\b|\bapache ?1 1\b"),
    ("APACHE1", "apache", r"apache (software )?licen[cs]e (v|version )?1( 0)?\b"),
    ("APACHEURL", "apache", r"www apache org licenses license 2 0"),
    ("APACHE", "apache", r"apache (software )?licen[cs]e\b"),
    ("MPL11", "mozilla|mpl", r"mozilla public licen[cs]e v?(ersion)? ?1 1\b|\bmpl ?1 1\b"),
    ("MPL1", "mozilla|mpl", r"mozilla public licen[cs]e v?(ersion)? ?1( 0)?\b|\bmpl ?1 0\b"),
    ("MPL2", "mozilla|mpl", r"mozilla public licen[cs]e v?(ersion)? ?2( 0)?\b|\bmpl ?2 0\b"),
    ("MPL", "mozilla", r"mozilla public licen[cs]e"),
    ("EPL1", "eclipse|epl", r"eclipse public licen[cs]e v?(ersion)? ?1( 0)?\b|\bepl ?1 0\b"),
    ("EPL2", "eclipse|epl", r"eclipse public licen[cs]e v?(ersion)? ?2( 0)?\b|\bepl ?2 0\b"),
    ("EPL", "eclipse", r"eclipse public licen[cs]e"),
    ("EUPL", "european|eupl", r"european union public licen[cs]e|\beupl\b"),
    ("ARTISTIC2", "artistic", r"artistic licen[cs]e v?(ersion)? ?2\b"),
    ("ARTISTIC", "artistic", r"artistic licen[cs]e"),
    ("BOOST", "boost", r"boost software licen[cs]e"),
    ("ZLIB", "zlib", r"\bzlib licen[cs]e\b"),
    ("WTFPL", "wtfpl|want", r"do what the f[a-z]* ?(ck )?you want to public licen[cs]e|\bwtfpl\b"),
    ("CCBYNCND", "cc|commons", r"\bcc by nc nd\b|creative commons attribution non ?commercial no ?deriv"),
    ("CCBYNCSA", "cc|commons", r"\bcc by nc sa\b|creative commons attribution non ?commercial share ?alike"),
    ("CCBYNC", "cc|commons", r"\bcc by nc\b|creative commons attribution non ?commercial"),
    ("CCBYSA", "cc|commons", r"\bcc by sa\b|creative commons attribution share ?alike"),
    ("CCBYND", "cc|commons", r"\bcc by nd\b|creative commons attribution no ?deriv"),
    ("CCBY", "cc|commons", r"\bcc by\b|creative commons attribution"),
    ("CC0", "cc0|commons", r"\bcc0\b|creative commons zero"),
    ("MITNAME", "mit", r"\bmit licen[cs]e\b|licen[cs]ed under (the )?mit\b"),
    ("BSDNAME", "bsd", r"\b(bsd )?[0-9] clause bsd licen[cs]e\b|\bbsd [0-9] clause( licen[cs]e)?\b|\bbsd licen[cs]e\b"),
    ("ISCNAME", "isc", r"\bisc licen[cs]e\b"),
    ("PUBLIC", "domain", r"(released|placed|dedicated|is) (in|into|to) the public domain"),
    ("UNLICENSE", "unencumbered", r"this is free and unencumbered software"),
    ("RESERVED", "reserved", r"\ball rights reserved\b"),
    ("COPYRIGHT", "copyright", r"\bcopyright (c )?[0-9]{4}"),
    ("OTHER", "licen[cs]ed?|terms", r"\blicen[cs]ed under\b|\blicen[cs]e agreement\b|\bunder the terms of\b"),
)

#: Licences, and the identifier sequences (each identifier ends with a comma) that show them, in order.
RULES = (
    # all rights are reserved in many a licence's own head: what a licence follows at once shows nothing
    ("", r"(COPYRIGHT,)*RESERVED,(?=(COPYRIGHT,)*(?!RESERVED|COPYRIGHT|ASIS|LATER)[A-Z0-9]+,)"),
    ("BSD-3-Clause", r"(BSDNAME,)?BSDHEAD,BSDSOURCE,BSDBINARY,BSDENDORSE,(ASIS,)?"),
    ("BSD-2-Clause", r"(BSDNAME,)?BSDHEAD,BSDSOURCE,BSDBINARY,(ASIS,)?"),
    ("MIT", r"(MITNAME,)?MITGRANT,(MITNOTICE,)?(ASIS,)?"),
    ("ISC", r"(ISCNAME,)?ISCGRANT,(ASIS,)?|(OTHER,)?ISCNAME,"),
    ("BSL-1.0", r"(BOOST,)?BOOSTGRANT,(ASIS,)?|(OTHER,)?BOOST,"),
    ("Zlib", r"(ZLIB,)?(ASIS,)?ZLIBGRANT,|(OTHER,)?ZLIB,"),
    ("AGPL-3.0-or-later", r"(OTHER,)?(AGPL3,)?AGPL3LATER,|(OTHER,)?AGPL3,LATER,"),
    ("AGPL-3.0", r"(OTHER,)?AGPL3,"),
    ("AGPL-1.0", r"(OTHER,)?AGPL1,(LATER,)?"),
    ("AGPL", r"(OTHER,)?AGPL,(LATER,)?"),
    ("LGPL-3.0-or-later", r"(OTHER,)?(LGPL3,)?LGPL3LATER,|(OTHER,)?LGPL3,LATER,"),
    ("LGPL-3.0", r"(OTHER,)?LGPL3,"),
    ("LGPL-2.1-or-later", r"(OTHER,)?(LGPL21,)?LGPL21LATER,|(OTHER,)?LGPL21,LATER,"),
    ("LGPL-2.1", r"(OTHER,)?LGPL21,"),
    ("LGPL-2.0-or-later", r"(OTHER,)?(LGPL2,)?LGPL2LATER,|(OTHER,)?LGPL2,LATER,"),
    ("LGPL-2.0", r"(OTHER,)?LGPL2,"),
    ("LGPL", r"(OTHER,)?LGPL,(LATER,)?"),
    ("GPL-3.0-or-later", r"(OTHER,)?GPL3LATER,|(OTHER,)?GPL3,LATER,"),
    ("GPL-3.0", r"(OTHER,)?GPL3,"),
    ("GPL-2.0-or-later", r"(OTHER,)?GPL2LATER,|(OTHER,)?GPL2,LATER,"),
    ("GPL-2.0", r"(OTHER,)?GPL2,"),
    ("GPL", r"(OTHER,)?GPL,(LATER,)?"),
    ("Apache-2.0", r"(OTHER,)?APACHE2,(APACHEURL,)?|(OTHER,)?(APACHE,)?APACHEURL,"),
    ("Apache-1.1", r"(OTHER,)?APACHE11,"),
    ("Apache-1.0", r"(OTHER,)?APACHE1,"),
    ("Apache", r"(OTHER,)?APACHE,"),
    ("MPL-1.1", r"(OTHER,)?MPL11,"),
    ("MPL-1.0", r"(OTHER,)?MPL1,"),
    ("MPL-2.0", r"(OTHER,)?MPL2,"),
    ("MPL", r"(OTHER,)?MPL,"),
    ("EPL-1.0", r"(OTHER,)?EPL1,"),
    ("EPL-2.0", r"(OTHER,)?EPL2,"),
    ("EPL", r"(OTHER,)?EPL,"),
    ("EUPL", r"(OTHER,)?EUPL,"),
    ("Artistic-2.0", r"(OTHER,)?ARTISTIC2,"),
    ("Artistic", r"(OTHER,)?ARTISTIC,"),
    ("WTFPL", r"(OTHER,)?WTFPL,"),
    ("CC-BY-NC-ND", r"(OTHER,)?CCBYNCND,"),
    ("CC-BY-NC-SA", r"(OTHER,)?CCBYNCSA,"),
    ("CC-BY-NC", r"(OTHER,)?CCBYNC,"),
    ("CC-BY-SA", r"(OTHER,)?CCBYSA,"),
    ("CC-BY-ND", r"(OTHER,)?CCBYND,"),
    ("CC-BY", r"(OTHER,)?CCBY,"),
    ("CC0-1.0", r"(OTHER,)?CC0,"),
    ("Unlicense", r"UNLICENSE,(PUBLIC,)?"),
    ("Public-Domain", r"PUBLIC,"),
    ("MIT", r"(OTHER,)?MITNAME,"),
    ("BSD", r"(OTHER,)?BSDNAME,"),
    ("Proprietary", r"(COPYRIGHT,)?RESERVED,"),
    ("Unknown", r"OTHER,"),
)

#: Any text with a known sentence has one of its words; others are not normalised at all.
HINT = "(?i)" + "|".join(sorted({w for _, w, _ in SENTENCES}))
#: Marks of comments and lists at the start of a line, and sentence ends.
MARKS, ENDS = r"(?m)^[ \t]*(?:[#*;%>]+|//+|--+|[0-9a-z][.)])[ \t]", r"\n[ \t\r]*\n\s*|(?<!\b[vV])[.!?]+\s+|\f"
ANY = "|".join(f"(?:{p})" for _, _, p in SENTENCES)
#: An SPDX line and its expression, whose names keep their case.
SPDX = r"(?i)SPDX-Licen[cs]e-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])"


def _identify(sentence: Column) -> Column:
    out = F.lit("")
    for name, _, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(f"^(?:{pattern})"), F.lit(name)).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences (licence sentences), sentence_ids and licences.

    sentence_ids has each identifier in order, comma after each; licences those shown, in order of the rules, after the
    names in SPDX lines in theirs (AND, OR and WITH part them), separated by ``;`` and each once. Both are '' where nothing
    is found, so also for null, empty and blank texts. Whole texts of any length are read. Repeated rows give repeated
    rows, an empty table an empty one; other columns may have any name.
    """
    tagged = text_or_empty().rlike(r"(?i)spdx-licen[cs]e")
    lines = F.when(tagged, F.regexp_replace("text", rf"({SPDX}[^\n]*)\n", "$1\n\n")).otherwise(F.col("text"))  # such a line is a sentence
    text = F.when(text_or_empty().rlike(HINT), F.regexp_replace(F.regexp_replace(lines, MARKS, " "), ENDS, " | ")).otherwise(F.lit(""))
    normal = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9|]+", " "), r"\s*\|[\s|]*", " | ")
    ids = F.transform(F.regexp_extract_all(normal, F.lit(ANY), F.lit(0)), _identify)
    tags = F.when(tagged, F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).otherwise(F.array().cast("array<string>"))
    tags = F.filter(F.flatten(F.transform(tags, lambda t: F.split(F.regexp_replace(t, r"[()]", ""), r"\s+(?:AND|OR|WITH|and|or|with)\s+"))), lambda t: t != "")
    out = docs.select("doc_id", ids.alias("ids"), F.transform(tags, lambda t: F.trim(F.split(F.trim(t), r"\s")[0])).alias("tags"))
    out = out.select("doc_id", "tags", F.size("ids").alias("n_sentences"), F.concat(F.array_join("ids", ","), F.when(F.size("ids") > 0, ",").otherwise("")).alias("sentence_ids"))
    # rules look at what earlier ones left: one step per rule keeps the expression linear
    rest = unused_name(out, "rest")
    step = out.withColumn(rest, F.col("sentence_ids"))
    names = []
    for i, (name, rule) in enumerate(RULES):
        bounded = rf"(^|,)({rule})"
        step = step.withColumn(f"rule_{i}", F.when((F.col(rest) != "") & F.col(rest).rlike(bounded), F.lit(name)))
        step = step.withColumn(rest, F.when(F.col(f"rule_{i}").isNotNull(), F.regexp_replace(rest, bounded, "$1#,")).otherwise(F.col(rest)))
        names += [F.col(f"rule_{i}")] if name else []
    shown = F.array_distinct(F.concat(F.col("tags"), F.array_compact(F.array(*names))))
    return step.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), "sentence_ids", F.array_join(shown, ";").alias("licences"))


#: Written by hand for the sentences that the driver's documents hold, not made from the tables above: licences by plain
#: search of the text, with the identifiers of the five lines that occur.
ORACLE = r"""
WITH low AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS t FROM documents),
found AS (
  SELECT doc_id, list_transform(regexp_extract_all(t, 'all rights reserved|released under the mit license|licensed under the apache license version 2|licensed under cc by nc|licensed under the gnu general public license version 3'),
    lambda s: CASE WHEN s = 'all rights reserved' THEN 'RESERVED,' WHEN s LIKE '%mit license' THEN 'MITNAME,' WHEN s LIKE '%apache%' THEN 'OTHER,APACHE2,'
      WHEN s LIKE '%cc by nc' THEN 'OTHER,CCBYNC,' ELSE 'OTHER,GPL3,' END) AS ids FROM low),
joined AS (SELECT doc_id, array_to_string(ids, '') AS sentence_ids FROM found)
SELECT doc_id, (length(sentence_ids) - length(replace(sentence_ids, ',', '')))::BIGINT AS n_sentences, sentence_ids,
  array_to_string(list_filter([
    CASE WHEN contains(sentence_ids, 'GPL3') THEN 'GPL-3.0' END, CASE WHEN contains(sentence_ids, 'APACHE2') THEN 'Apache-2.0' END,
    CASE WHEN contains(sentence_ids, 'CCBYNC') THEN 'CC-BY-NC' END, CASE WHEN contains(sentence_ids, 'MITNAME') THEN 'MIT' END,
    CASE WHEN regexp_matches(sentence_ids, 'RESERVED,(RESERVED,|$)') THEN 'Proprietary' END], lambda x: x IS NOT NULL), ';') AS licences
FROM joined
"""
