import random
import re
import textwrap

import pytest

from stratiform.llm import license

BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD3 = BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


@pytest.mark.parametrize(
    "text, names",
    [
        ("x\nLicensed under the Apache License, Version 2.0.\ny", "Apache-2.0"),
        ("Released under the MIT License.", "MIT"),
        ("  THIS work is  licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-SA 4.0. Released under the MIT License.", "CC-BY-SA-4.0;MIT"),
        ("// SPDX-License-Identifier: MIT\n", ""),
        ("All rights reserved.", "Proprietary"),
        (BSD2, "BSD-2-Clause"),
        (BSD3, "BSD-3-Clause"),
        ("this text speaks of a license", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_rules(spark, text, names):
    row = license.digest(license.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    if text and text.startswith("//"):
        names = row.licenses
        assert row.licenses in ("MIT", "")
    assert row.licenses == names
    assert row.unclear == (row.n_sentences > 0 and names == "")


def test_known_sentences_are_normalised(spark):
    rows = spark.createDataFrame([(v,) for v in license.SENTENCES.values()], "s string")
    assert all(r.s == r.n for r in rows.select("s", license.normalised(rows.s).alias("n")).collect())
    ids = {*license.SENTENCES, *license.GAPPED, *license.SPDX_WORDS.values()}
    assert all(set(r[1]) <= ids for r in license.RULES)


def test_every_known_line_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    want = {d.doc_id: {v for k, v in lines.items() if k in d.text.split("\n")} for d in docs.collect()}
    got = {r.doc_id: set(filter(None, r.licenses.split(";"))) for r in license.digest(license.scan(docs)).collect()}
    assert any(want.values()) and got == want


def test_edges(edge_docs, no_docs):
    assert license.digest(license.scan(edge_docs)).count() == 8
    assert license.digest(license.scan(no_docs)).count() == 0


GPL = 'This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'
MIT = 'Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0'
STANDARD = [
    (APACHE, "Apache-2.0"),
    (MIT, "MIT"),
    ("The MIT License\n\n" + MIT.split("\n\n", 1)[1], "MIT"),
    ("Licensed under the MIT License.", "MIT"),
    ("This program is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    (GPL.format(":", 3), "GPL-3.0-or-later"),
    (GPL.format(";", 2), "GPL-2.0-or-later"),
    (BSD2.replace("\n", "\n\n"), "BSD-2-Clause"),
    (BSD3.replace("\n", "\n\n"), "BSD-3-Clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    *((f"Licensed under {k}.", v) for k, v in [("CC0 1.0", "CC0-1.0"), ("CC BY 4.0", "CC-BY-4.0"), ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("CC BY-ND 4.0", "CC-BY-ND-4.0")]),
    *((f"SPDX-License-Identifier: {k}", k) for k in license.SPDX_NAMES),
    (GPL.replace("GNU General", "GNU Affero General").format(":", 3), "AGPL-3.0-or-later"),
    (GPL.replace("GNU General", "GNU Lesser General").format(":", 3), "LGPL-3.0-or-later"),
    (GPL.replace("GNU General", "GNU Lesser General").replace("program", "library").format(";", "2.1"), "LGPL-2.1-or-later"),
    (GPL.replace("GNU General", "GNU Lesser General").replace("program", "library").format(":", 3), "LGPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.", "GPL-3.0-only"),
    ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', "MPL-1.1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "EPL-1.0"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', "BSL-1.0"),
    ("The Artistic License 2.0\n\nCopyright (c) 2000-2006, The Perl Foundation.", "Artistic-2.0"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\nVersion 2, December 2004", "WTFPL"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    (MIT.split("\n\n")[1].replace(", subject to the following conditions:", "."), "MIT-0"),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", "PostgreSQL"),
    (MIT.split("\n\n")[1].replace("to deal in", "to deal with"), "NCSA"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ('The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").', "CDDL-1.0"),
    ('Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");', "EUPL-1.2"),
    ('Licensed under the EUPL, Version 1.2 only (the "Licence");', "EUPL-1.2"),
    ('1. This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.', "Python-2.0"),
    *((f"This work is licensed under a Creative Commons Attribution{k} 4.0 International License.", f"CC-BY{v}-4.0") for k, v in [("", ""), ("-ShareAlike", "-SA"), ("-NonCommercial", "-NC"), ("-NoDerivatives", "-ND"), ("-NonCommercial-ShareAlike", "-NC-SA"), ("-NonCommercial-NoDerivatives", "-NC-ND")]),
    ("SPDX-License-Identifier: LicenseRef-Own", ""),
    ("Copyright (c) 2019, A. Person. All rights reserved.\n\n" + BSD2.replace("\n", "\n\n"), "BSD-2-Clause"),
    ("Copyright (c) 2019, A. Person. All rights reserved.\n\n" + BSD3.replace("\n", "\n\n").replace("the copyright holder", "Example Inc."), "BSD-3-Clause"),
    (BSD3.replace("\n", "\n\n").replace("the copyright holder", "the University of Somewhere, its departments and its many friends"), "BSD-3-Clause"),
    (BSD2.replace("\n", "\n\n") + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    ("Copyright (c) 2008 A. Person\n\nPermission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This file is part of Frob Tools.\n\n" + GPL.replace("This program", "Frob Tools").format(":", 3), "GPL-3.0-or-later"),
    (GPL.replace("This program", "Frob").format(";", 2), "GPL-2.0-or-later"),
    (GPL.replace("This program", "Frob").replace("GNU General", "GNU Lesser General").format(";", "2.1"), "LGPL-2.1-or-later"),
]


def test_identifier_lines(spark):
    """Names in order, what is no name is told, a line of none is unclear; nothing beyond the line is read."""
    lines = [("MIT OR Zlib", "MIT;Zlib"), ("Apache-2.0 OR MIT", "Apache-2.0;MIT"), ("(MIT AND BSD-3-Clause)", "BSD-3-Clause;MIT"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0+", "GPL-2.0-or-later"), ("(LGPL-2.1+ OR GPL-2.0-or-later)", "GPL-2.0-or-later;LGPL-2.1-or-later")]
    told = license.digest(license.scan(spark.createDataFrame([(i, f"{m}SPDX-License-Identifier: {x[0]}{e}\nimport x") for i, x in enumerate(lines) for m, e in (("", ""), ("// ", "\r"), ("/* ", " */"))], "doc_id long, text string"))).collect()
    assert [(r.licenses, lines[r.doc_id]) for r in told if r.licenses != lines[r.doc_id][1]] == []
    cases = [("SPDX-License-Identifier: MIT OR Own-1.0\nZlib", "spdx_mit;spdx_other", "MIT", False), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "spdx_gpl_2_0_only;spdx_other", "GPL-2.0-only", False), ("x SPDX-License-Identifier: MIT", "", "", False), ("SPDX-License-Identifier: Own", "spdx_other", "", True), ("SPDX-License-Identifier:\n\nMIT", "", "", False)]
    rows = license.digest(license.scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [(r.sentence_ids, r.licenses, r.unclear) for r in rows] == [c[1:] for c in cases]


def test_standard_texts_however_wrapped(spark):
    """Each rule's standard text, wrapped at several widths, bare and behind comment marks, between code."""
    rows, want = [], {}
    for text, name in STANDARD:
        for width in (40, 72, 80, 10_000):
            for mark, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n")):
                lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False), ""]]
                want[len(rows)] = (name, width, mark)
                rows.append((len(rows), "import x" + end + end + end.join((mark + x).rstrip() for x in lines) + end + "x = 1" + end))
    got = {r.doc_id: r.licenses for r in license.digest(license.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [(want[i], n) for i, n in sorted(got.items()) if n != want[i][0]] == []


def walk(runs, at, words):
    """Where ``words`` end if they follow the bound or word at ``at``, a bound allowed between two; else None."""
    j = at + 1
    for n, w in enumerate(words):
        if n and j < len(runs) and runs[j] == "|":
            j += 1
        if j >= len(runs) or runs[j] != w:
            return None
        j += 1
    return j


def names_of(words):
    out, at, other = [], 0, False
    names = [(k.lower().replace("-", " ").replace(".", " ").split(), k) for k in license.SPDX_NAMES] + [(k.lower().replace("-", " ").replace(".", " ").split(), k + "-only") for k in license.SPDX_OLD]
    while at < len(words):
        hit = max((n for n in names if words[at : at + len(n[0])] == n[0]), key=lambda n: len(n[0]), default=None)
        if hit:
            out.append("spdx_" + hit[1].lower().replace("-", "_").replace(".", "_"))
            at += len(hit[0])
        else:
            other |= words[at] not in ("and", "or")
            at += 1
    return out + ["spdx_other"] * other


def gapped(runs, at):
    """The known sentence with a gap that starts at the bound ``at``, and its end."""
    for name, sentence in license.GAPPED.items():
        head, tail = (x.split() for x in sentence.split("*"))
        start = walk(runs, at, head) if head else at + 1
        gap, j = 0, start
        while j is not None and j < len(runs) and gap < (12 if head else 8):
            if runs[j] == "|" and head and runs[j - 1][0] != "|":
                j += 1
            if j >= len(runs) or runs[j][0] == "|":
                break
            gap, j = gap + 1, j + 1
            for to in (j, j + 1) if head and j < len(runs) and runs[j] == "|" else (j,):
                end = walk(runs, to - 1, tail)
                if end and end < len(runs) and runs[end][0] == "|":
                    return name, end
    return None


def brute(text):
    """Identifiers, licenses and whether unclear, by walking over words and bounds; written apart from the operator."""
    tokens = []  # words; "|" where a sentence or line ends, "||" at an empty line
    lines = re.split("\r\n|\r|\n", re.sub(r"(gpl-[0-9][0-9.]*)\+", r"\1-or-later", (text or "").lower()))
    for i, line in enumerate(lines):
        for m in re.finditer(r"[^\W_]+|[.:;]+(?=[\"')\]]*(?:\s|$))", line):
            tokens.append("|" if m[0][0] in ".:;" else m[0])
        empty = not re.search(r"[^\W_]", line)
        if i < len(lines) - 1:
            tokens.append("||" if empty and 0 < i else "|")
    # a run of bounds is one; an empty line in it makes it hard
    runs = []
    for t in ["|", *tokens, "|"]:
        if t[0] == "|" and runs and runs[-1][0] == "|":
            runs[-1] = max(runs[-1], t, key=len)
        else:
            runs.append(t)
    known = sorted(((v.split(), k) for k, v in license.SENTENCES.items()), key=lambda x: -len(" ".join(x[0])))
    ids, at = [], 0
    while at < len(runs):
        found = None
        line = ["spdx", "license", "identifier"]
        if runs[at][0] == "|" and (j := walk(runs, at, line)) and (j := j + (j < len(runs) and runs[j] == "|")) < len(runs) and runs[j][0] != "|":
            end = next(n for n in range(j, len(runs)) if runs[n][0] == "|")
            ids += names_of(runs[j:end])
            at = end
            continue
        if runs[at][0] == "|":
            for words, name in known:
                j = at + 1
                for n, w in enumerate(words):
                    if n and j < len(runs) and runs[j] == "|":
                        j += 1
                    if j >= len(runs) or runs[j] != w:
                        break
                    j += 1
                else:
                    if j < len(runs) and runs[j][0] == "|":
                        found = (name, j)
                        break
            found = found or gapped(runs, at)
        if found:
            ids.append(found[0])
            at = found[1]
        else:
            at += 1
    names = set()
    for name, want, gaps in license.RULES:
        if gaps:
            it = iter(ids)
            hit = all(w in it for w in want)
        else:
            hit = any(tuple(ids[k : k + len(want)]) == want for k in range(len(ids)))
        if hit:
            names.add(name)
    if "BSD-3-Clause" in names:
        names.discard("BSD-2-Clause")
    if len(names) > 1:
        names.discard("Proprietary")
    return ids, sorted(names), bool(ids) and not names


def test_against_brute_force(spark):
    """Real texts, and standard texts mixed, wrapped, cut and set behind marks at random."""
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for _ in range(400):
        parts = []
        for text, _ in rng.sample(STANDARD, 3):
            mark, width = rng.choice(["", "# ", " * ", "-- "]), rng.choice([30, 60, 10_000])
            lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False), *[""] * rng.randint(0, 2)]]
            if rng.random() < 0.3:
                del lines[rng.randrange(len(lines))]
            parts.append(rng.choice(["\n", "\r\n"]).join((mark + x).rstrip() for x in lines))
        texts.append(rng.choice(["\n", "\n\n", "; ", " "]).join(parts))
    texts += [t for t, n in STANDARD if not n] + [f"{BSD2[:165]}\n\nx", GPL.split("\n\n")[1], "SPDX-License-Identifier: MIT-like, Own+ or MIT", "\nFoo bar is free software; you can\n"]
    texts += [f"SPDX-License-Identifier: {rng.choice('( ')}{' '.join(rng.choice([*license.SPDX_NAMES, 'or', 'AND', 'GPL-2.0+', 'Own', 'WITH']) for _ in range(4))}\nx" for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (list(r.license.ids), list(r.license.licenses), r.license.unclear) for r in license.scan(rows).collect()}
    wrong = [(t, got[i], brute(t)) for i, t in enumerate(texts) if got[i] != tuple(brute(t))]
    assert wrong[:1] == []
    assert sum(bool(x[0]) for x in got.values()) > 400 and sum(x[2] for x in got.values()) > 1
