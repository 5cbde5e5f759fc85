"""Licence headers with names of their own, wrapped and commented in several ways."""

import textwrap

import pytest

LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
DETAILS = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BODY = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."

#: (text, licence); each is also tried wrapped at 40 and 72 columns, behind comment marks and at one word a line.
HEADERS = [
    (LGPL, "LGPL-2.1"),
    (LGPL + " " + DETAILS.replace("General", "Lesser General"), "LGPL-2.1"),
    (LGPL.replace("2.1", "3"), "LGPL-3.0"),
    (LGPL.replace("This library", "Foo").replace("2.1", "3"), "LGPL-3.0"),
    (GPL2, "GPL-2.0"),
    (GPL2 + " " + DETAILS, "GPL-2.0"),
    (GPL2.replace("version 2", "version 3"), "GPL-3.0"),
    (GPL2.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), "AGPL-3.0"),
    (MIT, "MIT"),
    ("Copyright (c) 2019 Some One\n\n" + MIT, "MIT"),
    (APACHE, "Apache-2.0"),
    ("Copyright 2020 The Authors\n\n" + APACHE, "Apache-2.0"),
    (BODY + "\n\n" + CLAUSES, "BSD-2-Clause"),
    (BODY + "\n\n" + CLAUSES + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
]
#: Titles and one-liners, as they stand.
LINES = [
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-2.1"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"),
    ("BSD 2-Clause License", "BSD-2-Clause"),
    ("BSD 3-Clause License", "BSD-3-Clause"),
    ("MIT License", "MIT"),
    ("MIT No Attribution", "MIT-0"),
    ("ISC License", "ISC"),
    ("Licensed under the EUPL, Version 1.2", "EUPL-1.2"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("-- SPDX-License-Identifier: CC0-1.0", "CC0-1.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Some prose without an end\nThis work is licensed under the GNU General Public License, version 3.\nand more of it", "GPL-3.0"),
    ("All rights reserved.", "Proprietary"),
    ("We need a licence to fish here, and permission of the owner.", None),
    ("The library lends books; the license plate was lost.", None),
    ("redistribution of wealth is a topic of this text", None),
]


def wrapped(text, width, mark):
    return "\n".join(mark + line for block in text.split("\n") for line in (textwrap.wrap(block, width) or [""]))


@pytest.fixture(scope="module")
def scanned(spark):
    from gridloom.llm.license_scan import license_scan

    rows, want = [], {}
    for text, name in HEADERS:
        for form in (text, wrapped(text, 40, "# "), wrapped(text, 72, " * "), wrapped(text, 60, "// "), "\n".join(text.split())):
            want[len(rows)] = (name, form)
            rows.append((len(rows), f"d{len(rows)}/f.c", form))
    for text, name in LINES:
        want[len(rows)] = (name, text)
        rows.append((len(rows), f"d{len(rows)}/f.c", text))
    return {r.file_id: r for r in license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}, want


def test_headers_get_their_own_names(scanned):
    got, want = scanned
    wrong = [(got[k].own_license, got[k].own_score, name, text[:40]) for k, (name, text) in want.items() if got[k].own_license != name]
    assert not wrong, wrong


def test_several_licences_of_a_file(spark):
    from gridloom.llm.license_scan import license_scan

    rows = [
        (1, "a/x", "# SPDX-License-Identifier: MIT OR Apache-2.0"),
        (2, "b/x", "SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause)"),
        (3, "c/x", LGPL + "\n\n" + MIT),
        (4, "d/x", "Released under the MIT License. All rights reserved."),
        (5, "e/x", "word " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 300_000),
        (6, "f/x", None),
        (7, None, "Released under the ISC License."),
    ]
    got = {r.file_id: r.own_licenses for r in license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: "Apache-2.0,MIT", 2: "BSD-3-Clause,GPL-2.0", 3: "LGPL-2.1,MIT", 4: "MIT", 5: "MIT", 6: None, 7: "ISC"}
