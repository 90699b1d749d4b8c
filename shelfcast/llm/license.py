"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences, which are normalised and looked up in a table of
known licence sentences; a known sentence may run on over lines that the cut
before a capitalised line has split.  The identifiers found, in order, are
matched against ordered rules.  Rules with more identifiers go first and use
up what they match, so a longer licence isn't reported as a shorter one too;
sentences that no rule uses are reported as left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier, then normalised sentences that stand for it.
SENTENCES: dict[str, list[str]] = {
    "MitName": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "the mit license", "mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "Permission": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MitLiability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "ApacheName": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0", "this work is licensed under the apache license version 2.0", "distributed under the apache license version 2.0", "apache license version 2.0"],
    "ApacheComply": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheLimits": ["see the license for the specific language governing permissions and limitations under the license"],
    "Gpl3Name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3"],
    "Gpl2Name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "gnu general public license version 2"],
    "GplFree": ["this program is free software"],
    "Gpl3Later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Gpl2Later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GplTerms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "Gpl3Either": ["either version 3 of the license or at your option any later version"],
    "Gpl2Either": ["either version 2 of the license or at your option any later version"],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "BsdName": ["licensed under the bsd license", "released under the bsd license"],
    "BsdGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CcBy": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "released under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CcBySa": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "released under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CcByNc": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "released under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "Mpl2": ["this source code form is subject to the terms of the mozilla public license v 2.0", "this source code form is subject to the terms of the mozilla public license v"],
    "MplCopy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"],
    "BsdAsIs": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BsdLiability": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"],
    "LgplFree": ["this library is free software"],
    "LgplTerms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "Lgpl21Either": ["either version 2.1 of the license or at your option any later version"],
    "LgplHope": ["this library is distributed in the hope that it will be useful but without any warranty"],
    "Lgpl3Name": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"],
    "AgplTerms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "Agpl3Later": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Lgpl3Later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Agpl3Name": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"],
    "IscName": ["isc license", "the isc license", "licensed under the isc license", "released under the isc license"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "IscAsIs": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "IscLiability": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "UnlicenseFree": ["this is free and unencumbered software released into the public domain"],
    "UnlicenseAnyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "ZlibAsIs": ["this software is provided as is without any express or implied warranty"],
    "ZlibLiability": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "ZlibGrant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "Epl2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0", "licensed under the eclipse public license 2.0"],
    "Cc0": ["licensed under cc0 1.0", "this work is licensed under cc0 1.0", "released under cc0 1.0", "cc0 1.0 universal"],
    "Artistic2": ["licensed under the artistic license 2.0", "released under the artistic license 2.0", "the artistic license 2.0"],
    "Proprietary": ["all rights reserved"],
    "SpdxTag": ["spdx license identifier"],
}

#: Licence, then its identifiers in order.  Longer rules are tried first; ties in this order.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MitName", "Permission", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("Permission", "MitNotice", "MitAsIs", "MitLiability")),
    ("Apache-2.0", ("ApacheName", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheLimits")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "Lgpl21Either", "LgplHope")),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms", "Gpl3Either", "GplHope")),
    ("ISC", ("IscName", "IscGrant", "IscAsIs", "IscLiability")),
    ("ISC", ("IscGrant", "IscAsIs", "IscLiability")),
    ("Zlib", ("ZlibAsIs", "ZlibLiability", "ZlibGrant")),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("MPL-2.0", ("Mpl2", "MplCopy")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "Lgpl21Either")),
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3Later", "GplHope")),
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3Later")),
    ("LGPL-3.0-or-later", ("LgplFree", "Lgpl3Later")),
    ("LGPL-3.0-or-later", ("GplFree", "Lgpl3Later")),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms", "Gpl3Either")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Gpl3Either", "GplHope")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Gpl2Either", "GplHope")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Later", "GplHope")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Later", "GplHope")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Gpl3Either")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Gpl2Either")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Later")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Later")),
    ("MIT", ("MitName",)),
    ("Apache-2.0", ("ApacheName",)),
    ("GPL-3.0-only", ("Gpl3Name",)),
    ("GPL-2.0-only", ("Gpl2Name",)),
    ("BSD", ("BsdName",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("MPL-2.0", ("Mpl2",)),
    ("LGPL-3.0-only", ("Lgpl3Name",)),
    ("AGPL-3.0-only", ("Agpl3Name",)),
    ("ISC", ("IscName",)),
    ("Unlicense", ("UnlicenseFree",)),
    ("EPL-2.0", ("Epl2",)),
    ("CC0-1.0", ("Cc0",)),
    ("Artistic-2.0", ("Artistic2",)),
    ("Proprietary", ("Proprietary",)),
]

#: Licences whose name alone counts after an SPDX tag.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "ISC", "MPL-2.0", "Unlicense", "Zlib", "EPL-2.0", "CC0-1.0", "Artistic-2.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
SENTENCES |= {f"Spdx:{name}": [name.lower().replace("-", " ")] for name in SPDX}
RULES += [(name, ("SpdxTag", f"Spdx:{name}")) for name in SPDX]

#: A line that starts like a sentence may start one, or go on with a wrapped one: the mark WRAP stands before it.
LINE = r"\n([^A-Za-z0-9\n]*[A-Z][a-z])"
CUT, WRAP = "\x01", "\x02"
#: A sentence surely ends at a mark before white space or the end, and at an empty line.
ENDS = r"[.;:!?]+(?:[\s\x02]|$)|\n\s*[\n\x02]"


def known_sentences(text: Column) -> Column:
    """The known sentences of a text in order, normalised: lower case, letters, digits, inner points and plus signs, single spaces.

    A known sentence starts and ends at a CUT or WRAP or an end of the text,
    and may have a WRAP between two of its words; the longest goes first.
    """
    marked = F.regexp_replace(F.translate(text, WRAP, " "), LINE, WRAP + "$1")
    plain = F.regexp_replace(F.lower(F.regexp_replace(marked, ENDS, CUT)), "[^a-z0-9.+\x01\x02]+", " ")
    names = sorted((t for texts in SENTENCES.values() for t in texts), key=len, reverse=True)
    any_of = "|".join(t.replace(".", r"\.").replace("+", r"\+").replace(" ", r"(?: |[ .]*+\x02[ .]*+)") for t in names)
    found = F.regexp_extract_all(plain, F.lit(rf"(?:^|[\x01\x02])[ .]*+({any_of})(?=[ .]*+(?:[\x01\x02]|$))"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, r"[ .]*+\x02[ .]*+", " "))


def by_length() -> list[tuple[str, tuple[str, ...]]]:
    return sorted(RULES, key=lambda r: -len(r[1]))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, sentence_ids array<string>, licences array<string>, left_over array<string>)`` for every row.

    licences are distinct and sorted.  Null, empty and unlicensed texts have
    empty arrays.  Repeated rows, null ids and further columns are no
    special cases; nothing is joined or shuffled.
    """
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.transform(known_sentences(F.col("text")), lambda s: F.element_at(known, s)).alias("sentence_ids"))
    rows = rows.withColumn("left", F.concat(F.lit(","), F.array_join(F.transform("sentence_ids", lambda s: F.concat(s, F.lit(",,"))), "")))
    for i, (_, ids) in enumerate(by_length()):
        pattern = "," + ",,".join(ids) + ","
        rows = (rows.withColumn(f"hit{i}", F.contains("left", F.lit(pattern)))
                .withColumn("left", F.replace("left", F.lit(pattern), F.lit(""))))
    hits = F.array(*[F.when(F.col(f"hit{i}"), F.lit(name)) for i, (name, _) in enumerate(by_length())])
    left = F.filter(F.split("left", ","), lambda s: s != "")
    return rows.select("doc_id", "sentence_ids", F.sort_array(F.array_distinct(F.array_compact(hits))).alias("licences"), left.alias("left_over"))
