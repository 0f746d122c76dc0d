import pytest

from assayer.llm import licenses as x

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES.
# See the License for the specific language governing permissions and limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software.
The above copyright notice and this permission notice shall be included in all copies.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Some prose.\nLicensed under the Apache License, Version 2.0.\nMore.", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("released under the  MIT License", ["MIT"]),
        ("x. All rights reserved.", ["proprietary"]),
        (APACHE, ["Apache-2.0"]),
        (MIT, ["MIT"]),
        (MIT + "\n" + APACHE, ["MIT", "Apache-2.0"]),
        (APACHE + "\nAll rights reserved.", ["Apache-2.0"]),
        ("All rights reserved.\n" + APACHE, ["Apache-2.0"]),
        ("All rights reserved.\n" + "Prose.\n" * 5 + APACHE, ["proprietary", "Apache-2.0"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: apache-2.0 OR mit", ["Apache-2.0 OR MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]),
        ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2.", ["GPL-2.0-only"]),
        ("This program is free software; you can redistribute it and/or modify it\nunder the terms of version 2 of the GNU General Public License.", ["GPL-2.0-only"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\nLicense as published by the FSF; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published, either version 3 of the License, or later.", ["AGPL-3.0-or-later"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not distributed, get one.", ["MPL-2.0"]),
        ('Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that it stays.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.', ["ISC"]),
        ("Released under the MIT License. Released under the MIT License.", ["MIT", "MIT"]),
        ("He was licensed to drive, with permission.", []),
        ("", []),
    ],
)
def test_licences(text, found):
    assert [hit[0] for hit in x.licences(x.identify(text))] == found


def test_order_and_gaps_decide():
    grant, notice, as_is = MIT.split("\n")
    assert x.licences(x.identify("\n".join([notice, grant, as_is]))) == []
    assert [h[0] for h in x.licences(x.identify("\n".join([grant, "One.", "Two.", notice, as_is])))] == ["MIT"]
    assert x.licences(x.identify("\n".join([grant, "One.", "Two.", "Three.", notice, as_is]))) == []


def test_every_rule_uses_known_identifiers():
    known = {identifier for identifier, _ in x.SENTENCES}
    assert all(set(wanted) <= known for wanted, _ in x.RULES)


def test_rows(docs):
    rows = [(1, "a. Licensed under CC BY-NC 4.0. b"), (2, None), (3, ""), (None, MIT), (1, "a. Licensed under CC BY-NC 4.0. b"), (4, "prose. " * 20_000 + MIT)]
    got = sorted(((r.doc_id, r.licence, r.first_sentence, r.last_sentence) for r in x.scan(docs(rows)).collect()), key=str)
    assert got == [(1, "CC-BY-NC-4.0", 1, 1), (1, "CC-BY-NC-4.0", 1, 1), (4, "MIT", 20_000, 20_002), (None, "MIT", 0, 2)]
    assert x.scan(docs([])).collect() == []


WRAPPED_APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License"); you may
 * not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
WRAPPED_MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
WRAPPED_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
{endorse}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, ARE DISCLAIMED."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WRAPPED_GPL = """# This program is free software{mark} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{comma} either version {version} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>."""


@pytest.mark.parametrize(
    ("text", "licence", "identifiers"),
    [
        (WRAPPED_APACHE, "Apache-2.0", 5),
        (WRAPPED_MIT, "MIT", 3),
        (WRAPPED_BSD.format(endorse=""), "BSD-2-Clause", 4),
        (WRAPPED_BSD.format(endorse=ENDORSE), "BSD-3-Clause", 5),
        (WRAPPED_GPL.format(mark=":", comma=",", version=3), "GPL-3.0-or-later", 3),
        (WRAPPED_GPL.format(mark=";", comma=";", version=2), "GPL-2.0-or-later", 3),
    ],
)
@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\r"])
def test_wrapped_notices(text, licence, identifiers, line_end):
    text = f"Some code\n\n{text}\n\nMore code.".replace("\n", line_end)
    assert [(h[0], len(h[3])) for h in x.licences(x.identify(text))] == [(licence, identifiers)]


def test_wrapped_names_and_lines_that_only_follow():
    assert [h[0] for h in x.licences(x.identify("This work is\nlicensed under the GNU General Public\nLicense, version 2."))] == ["GPL-2.0"]
    assert [h[0] for h in x.licences(x.identify("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 2 of the License."))] == ["GPL-2.0-or-later"]
    assert [h[0] for h in x.licences(x.identify("# SPDX-License-Identifier: MIT\n# with thanks\nimport a"))] == ["MIT"]
    assert x.licences(x.identify("The license\n\nunder the terms of the MIT License he sang")) == []
    assert [h[0] for h in x.licences(x.identify("# dedicated to the public\n# domain\n#\n# All rights\n# reserved"))] == ["CC0"]
    assert [h[0] for h in x.licences(x.identify("# Some prose.\n#\n# All rights\n# reserved"))] == ["proprietary"]
