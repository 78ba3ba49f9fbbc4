"""Recognition of licence files."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

# Words that mark a licence path, and per licence its one-line tag with the phrases that
# identify it. Each inner list must occur completely; any one of them suffices. The first licence that fits wins.
LICENSE_PATH_WORDS = ["license", "licence", "copying"]
LICENSES = [
    ("[mit license - https://opensource.org/licenses/MIT]",
     [["permission is hereby granted, free of charge", "mit license"],
      ["without restriction", "above copyright notice"]]),
    ("[apache license 2.0 - https://www.apache.org/licenses/LICENSE-2.0]",
     [["apache license", "version 2.0"]]),
    ("[gnu gpl v3 - https://www.gnu.org/licenses/gpl-3.0.html]",
     [["gnu general public license", "version 3"]]),
    ("[gnu gpl v2 - https://www.gnu.org/licenses/gpl-2.0.html]",
     [["gnu general public license", "version 2"]]),
    ("[bsd 3-clause license - https://opensource.org/licenses/BSD-3-Clause]",
     [["redistribution and use in source and binary forms", "neither the name of"]]),
    ("[bsd 2-clause license - https://opensource.org/licenses/BSD-2-Clause]",
     [["redistribution and use in source and binary forms"]]),
    ("[isc license - https://opensource.org/licenses/ISC]",
     [["isc license"],
      ["permission to use, copy, modify", "and/or sell copies"]]),
    ("[mozilla public license 2.0 - https://www.mozilla.org/MPL/2.0/]",
     [["mozilla public license", "version 2.0"]]),
    ("[gnu lgpl - https://www.gnu.org/licenses/lgpl.html]",
     [["gnu lesser general public license"]]),
    ("[gnu agpl - https://www.gnu.org/licenses/agpl.html]",
     [["gnu affero general public license"]]),
    ("[unlicense - public domain - https://unlicense.org/]",
     [["this is free and unencumbered software released into the public domain"]]),
    ("[creative commons license - see repository for details]",
     [["creative commons"]]),
]


def is_license_path(path: Column) -> Column:
    lowered = F.lower(path)
    return reduce(or_, [lowered.contains(word) for word in LICENSE_PATH_WORDS])


def license_tag(path: Column, text: Column) -> Column:
    """One-line tag of a recognised licence file, else NULL."""
    lowered = F.lower(text)
    tag = F.lit(None).cast("string")
    for label, alternatives in reversed(LICENSES):
        fits = reduce(or_, [reduce(and_, [lowered.contains(p) for p in phrases]) for phrases in alternatives])
        tag = F.when(fits, F.lit(label)).otherwise(tag)
    return F.when(is_license_path(path), tag)


def compressed_text(path: Column, text: Column) -> Column:
    return F.coalesce(license_tag(path, text), text)
