"""License scan by sentence rules: known sentences get identifiers, ordered rules match their sequence.

A text becomes one stream of words in which line ends, stops, colons and semicolons are bounds and
comment marks are gone. A known sentence starts and ends at a bound and may run across bounds, so it
is found however it is wrapped; only an empty line (or one of comment marks) always ends it. Those
that are known become identifiers (a few of them carry a version as part of the sentence, some have a
gap where a text puts a name of its own). An identifier line gives one identifier for each license in
its expression, and ``spdx_other`` if something in it is no known name. A rule is
an ordered list of identifiers, with or without gaps between them; each rule that matches names a
license, and an unmatched known sentence leaves the text marked as ``unclear``. Reserved rights make a
text proprietary only where no license is named.

Only Column expressions run; nothing is shuffled. Defined cases: null or empty text has no license;
null ids and repeated rows are carried along; other columns are ignored by ``digest`` and kept by
``scan``; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, by their identifiers.
SENTENCES = {
    "apache2_line": "licensed under the apache license version 2 0",
    "apache2_line_the": "licensed under the apache license version 2 0 the license",
    "apache2_use": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_as_is": "distributed under the license is distributed on an as is basis",
    "mit_line": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_name": "the mit license",
    "mit_name_short": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_line": "this work is licensed under the gnu general public license version 3",
    "gpl3_program": "this program is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2_line": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0_line": "licensed under cc0 1 0",
    "cc_by_line": "licensed under cc by 4 0",
    "cc_by_sa_line": "licensed under cc by sa 4 0",
    "cc_by_nc_line": "licensed under cc by nc 4 0",
    "cc_by_nc_sa_line": "licensed under cc by nc sa 4 0",
    "cc_by_nd_line": "licensed under cc by nd 4 0",
    "gpl2_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_see": "see the gnu affero general public license for more details",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl11_line": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl2_line": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1_line": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl_line": "distributed under the boost software license version 1 0",
    "bsl_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "artistic2_title": "the artistic license 2 0",
    "wtfpl_title": "do what the fuck you want to public license",
    "zero_bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "postgresql_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ncsa_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "ofl_line": "this font software is licensed under the sil open font license version 1 1",
    "cddl_line": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "eupl_line": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence",
    "eupl_only": "licensed under the eupl version 1 2 only the licence",
    "psf_line": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
    "cc_by_work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_sa_work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc_by_nc_work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc_by_nd_work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc_by_nc_sa_work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc_by_nc_nd_work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "bsd_endorse_author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "reserved": "all rights reserved",
}
# Known sentences with a gap, *, for a name. A gap at the start is of up to 8 words of one line, any other of up to 12.
GAPPED = {
    "bsd_endorse_named": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_free_named": "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free_named": "* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3_only_named": "* is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl2_only_named": "* is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "agpl3_free_named": "* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3_free_named": "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_free_named": "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gpl_warranty_named": "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
}
# Names that an identifier line may give; each makes a sentence and a rule of its own.
SPDX_NAMES = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
)
# Names of before, which mean the version alone.
SPDX_OLD = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
#: What starts an identifier line, and the words that join names in it.
SPDX_LINE, SPDX_JOINS = "spdx license identifier", ("and", "or")


def _spdx_id(name: str) -> str:
    return "spdx_" + name.lower().replace("-", "_").replace(".", "_")


def _spdx_words(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


#: Words of a name in an identifier line, and its identifier.
SPDX_WORDS = {_spdx_words(n): _spdx_id(n) for n in SPDX_NAMES} | {_spdx_words(n): _spdx_id(n + "-only") for n in SPDX_OLD}
# Fixed values: (license, identifiers in order, other known sentences may stand between). The first
# rule of a license that matches counts; a rule with more identifiers stands before its parts.
RULES = (
    ("Apache-2.0", ("apache2_line_the", "apache2_use", "apache2_copy"), True),
    ("Apache-2.0", ("apache2_line",), True),
    ("MIT", ("mit_grant", "mit_notice"), False),
    ("MIT", ("mit_line",), True),
    ("MIT", ("mit_licensed",), True),
    ("MIT", ("mit_name", "mit_grant"), False),
    ("GPL-3.0-only", ("gpl3_line",), True),
    ("GPL-3.0-only", ("gpl3_program",), True),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_warranty"), True),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_warranty"), True),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"), False),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary"), False),
    ("MPL-2.0", ("mpl2_line",), True),
    ("ISC", ("isc_grant",), True),
    ("Unlicense", ("unlicense",), True),
    ("CC0-1.0", ("cc0_line",), True),
    ("CC-BY-4.0", ("cc_by_line",), True),
    ("CC-BY-SA-4.0", ("cc_by_sa_line",), True),
    ("CC-BY-NC-4.0", ("cc_by_nc_line",), True),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_line",), True),
    ("CC-BY-ND-4.0", ("cc_by_nd_line",), True),
    ("GPL-2.0-only", ("gpl2_only",), True),
    ("GPL-3.0-only", ("gpl3_only",), True),
    ("AGPL-3.0-or-later", ("agpl3_free", "gpl_warranty", "agpl_see"), True),
    ("LGPL-2.1-or-later", ("lgpl21_free", "lgpl_warranty"), True),
    ("LGPL-3.0-or-later", ("lgpl3_free", "lgpl_warranty"), True),
    ("LGPL-3.0-or-later", ("lgpl3_program", "gpl_warranty", "lgpl_see"), True),
    ("MPL-1.1", ("mpl11_line",), True),
    ("EPL-2.0", ("epl2_line",), True),
    ("EPL-1.0", ("epl1_line",), True),
    ("Zlib", ("zlib_as_is", "zlib_grant"), True),
    ("BSL-1.0", ("bsl_line",), True),
    ("BSL-1.0", ("bsl_grant",), True),
    ("Artistic-2.0", ("artistic2_title",), True),
    ("WTFPL", ("wtfpl_title",), True),
    ("0BSD", ("zero_bsd_grant",), True),
    ("MIT-0", ("mit0_grant",), True),
    ("PostgreSQL", ("postgresql_grant",), True),
    ("NCSA", ("ncsa_grant",), True),
    ("OFL-1.1", ("ofl_line",), True),
    ("CDDL-1.0", ("cddl_line",), True),
    ("EUPL-1.2", ("eupl_line",), True),
    ("EUPL-1.2", ("eupl_only",), True),
    ("Python-2.0", ("psf_line",), True),
    ("CC-BY-4.0", ("cc_by_work",), True),
    ("CC-BY-SA-4.0", ("cc_by_sa_work",), True),
    ("CC-BY-NC-4.0", ("cc_by_nc_work",), True),
    ("CC-BY-ND-4.0", ("cc_by_nd_work",), True),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_work",), True),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_work",), True),
    ("Proprietary", ("reserved",), True),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse_named"), False),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse_author"), False),
    ("ISC", ("isc_grant_and",), True),
    ("GPL-3.0-or-later", ("gpl3_free_named",), True),
    ("GPL-2.0-or-later", ("gpl2_free_named",), True),
    ("GPL-3.0-only", ("gpl3_only_named",), True),
    ("GPL-2.0-only", ("gpl2_only_named",), True),
    ("AGPL-3.0-or-later", ("agpl3_free_named",), True),
    ("LGPL-3.0-or-later", ("lgpl3_free_named",), True),
    ("LGPL-2.1-or-later", ("lgpl21_free_named",), True),
    *((n, (_spdx_id(n),), True) for n in SPDX_NAMES),
)
#: Licenses whose rule gives way when a longer one of the pair also matches.
NARROWER = {"BSD-2-Clause": "BSD-3-Clause"}
#: What a text is that names no license.
UNNAMED = "Proprietary"
#: A text is read only if it holds one of these words.
HINT = "(?i)licen[sc]e|copyright|permission|redistribut|reserved|warrant|public domain|free\\W+software|use\\W+this\\W+file|a\\W+copy\\W+of\\W+the"
#: Bounds in the stream: of sentences, and at empty lines.
BOUND, EMPTY = "|", "||"
#: A full stop, colon or semicolon before white space, closing quotes and brackets aside.
_STOP = "[.:;]+(?=[\"')\\]]*(?:\\s|$))"


def normalised(sentence: Column) -> Column:
    """Letters and digits in lower case, single spaces between their runs."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^\\p{L}\\p{N}]+", " "))


def _loose(sentence: str) -> str:
    """A sentence between whose words may be one bound; a gap in it takes words as few as it can."""
    return sentence.replace(" ", "[ |]").replace("*", "[^ |]+(?:[ |][^ |]+){0,11}?")


_LEAD = "[^ |]+(?: [^ |]+){0,7}? "


def _known_pattern() -> str:
    """Any known sentence between bounds: identifier lines, then plain sentences, longer ones first, then those with gaps."""
    longest = lambda xs: sorted(xs, key=len, reverse=True)
    led = [x[2:] for x in GAPPED.values() if x.startswith("* ")]
    rest = [x for x in GAPPED.values() if not x.startswith("* ")]
    line = f"{SPDX_LINE.replace(' ', '[ |]')}[ |][^|]+"
    plain = "|".join(_loose(x) for x in [*longest(SENTENCES.values()), *longest(rest)])
    return f"(?<=\\|)(?:{line}|{plain}|{_LEAD}(?:{'|'.join(_loose(x) for x in longest(led))}))(?=\\|)"


def _gapped_pattern(sentence: str) -> str:
    return "^" + sentence.replace("*", ".+") + "$"


def _identifiers(sentence: Column) -> Column:
    """Those of one known sentence, an identifier line's in its order."""
    table = lambda x: F.create_map(*(F.lit(y) for y in chain.from_iterable(x.items())))
    s = F.translate(sentence, BOUND, " ")
    gapped = F.coalesce(*(F.when(s.rlike(_gapped_pattern(v)), F.lit(k)) for k, v in GAPPED.items()))
    one = F.array(F.coalesce(F.try_element_at(table({v: k for k, v in SENTENCES.items()}), s), gapped))
    names = "|".join(sorted(SPDX_WORDS, key=len, reverse=True))
    told = F.substring(s, len(SPDX_LINE) + 1, 1 << 30)
    named = F.transform(F.regexp_extract_all(told, F.lit(f"(?<= )(?:{names})(?= |$)"), F.lit(0)), lambda n: F.try_element_at(table(SPDX_WORDS), n))
    other = F.regexp_replace(told, f"(?<= )(?:{names}|{'|'.join(SPDX_JOINS)})(?= |$)", "").rlike("[^ ]")
    return F.when(s.startswith(SPDX_LINE + " "), F.concat(named, F.when(other, F.array(F.lit("spdx_other"))).otherwise(F.array().cast("array<string>")))).otherwise(one)


def stream(text: Column) -> Column:
    """Words of the text in lower case with ``BOUND`` or ``EMPTY`` between sentences and lines, and around all."""
    s = F.regexp_replace(F.translate(F.lower(text), "\x01\x02", "  "), "(gpl-[0-9][0-9.]*)\\+", "$1-or-later")
    for what, by in ((_STOP, "\x01"), ("\\r\\n?|\\n", "\x02"), ("[^\\p{L}\\p{N}\x01\x02]+", " "), ("[ \x01]*\x02[ \x01]*\x02[ \x01\x02]*", EMPTY), (" *[\x01\x02][ \x01\x02]*", BOUND)):
        s = F.regexp_replace(s, what, by)
    return F.concat(F.lit(BOUND), F.trim(s), F.lit(BOUND))


def _pattern(ids: tuple[str, ...], gaps: bool) -> str:
    between = ";(?:[^;]+;)*?" if gaps else ";"
    return f"(?:^|;){between.join(ids)}(?:;|$)"


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "license") -> DataFrame:
    """``docs`` with a struct in ``out_col``: ids (known sentences in order), licenses (sorted), unclear; a
    column of that name gives way."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sentences = F.regexp_extract_all(stream(text), F.lit(_known_pattern()), F.lit(0))
    ids = F.flatten(F.transform(sentences, _identifiers))
    found = docs.withColumn(out_col, F.when(text.rlike(HINT), F.array_join(ids, ";")).otherwise(""))
    seq = F.col(out_col)
    named = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(seq.rlike(_pattern(i, g)), F.lit(n)) for n, i, g in RULES)), lambda x: x.isNotNull())))
    for narrow, wide in NARROWER.items():
        named = F.when(F.array_contains(named, wide), F.array_remove(named, narrow)).otherwise(named)
    named = F.when(F.size(named) > 1, F.array_remove(named, UNNAMED)).otherwise(named)
    named = F.when(seq == "", F.array().cast("array<string>")).otherwise(named)
    return found.withColumn(out_col, F.struct(F.when(seq == "", F.array().cast("array<string>")).otherwise(F.split(seq, ";")).alias("ids"), named.alias("licenses"), ((seq != "") & (F.size(named) == 0)).alias("unclear")))


def digest(found: DataFrame, out_col: str = "license") -> DataFrame:
    """doc_id, number of known sentences, their identifiers and the licenses, semicolon-joined."""
    x = F.col(out_col)
    return found.select("doc_id", F.size(x["ids"]).cast("long").alias("n_sentences"), F.array_join(x["ids"], ";").alias("sentence_ids"), F.array_join(x["licenses"], ";").alias("licenses"), x["unclear"].alias("unclear"))
