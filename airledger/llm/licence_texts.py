"""Texts of well-known licences and their usual notices, by SPDX identifier."""

from __future__ import annotations

# Fixed values, in the wording of their publishers.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

BSD_3 = BSD_2.replace("THIS SOFTWARE IS", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS""")

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

MPL_2_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: The notice that the GNU licences ask for; {0} is what is covered, {1} the licence, {2} its version.
GNU_NOTICE = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."""
GNU_COPY = "You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."

#: What a licence is called in notices of one line, by SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0"],
}
#: The Creative Commons licences of versions 3.0 and 4.0, by their elements.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NAMES |= {
    f"CC-{short}-{version}": [f"CC {short} {version}", f"CC {short} {version} License", f"Creative Commons {long} {version} International License", f"Creative Commons {long} {version} License"]
    for short, long in CREATIVE.items() for version in ("3.0", "4.0")
}
#: Notices of one line about a licence; each also without "the" and with "the terms of".
NOTICES = ["Released under {}.", "Licensed under {}.", "Distributed under {}.", "Published under {}.", "Available under {}.", *[f"This {what} is {how} under {{}}." for what in ("work", "project", "software", "program", "file", "document", "code") for how in ("licensed", "released", "distributed")]]

#: (SPDX identifier, text); several texts may name one licence.
LICENCES = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", APACHE_NOTICE),
    ("MPL-2.0", MPL_2_NOTICE),
]
for _id, _name, _version in [("GPL-2.0-or-later", "General Public License", "2"), ("GPL-3.0-or-later", "General Public License", "3"), ("LGPL-2.1-or-later", "Lesser General Public License", "2.1"), ("LGPL-3.0-or-later", "Lesser General Public License", "3"), ("AGPL-3.0-or-later", "Affero General Public License", "3")]:
    for _what in ("program", "library", "software"):
        LICENCES += [(_id, GNU_NOTICE.format(_what, _name, _version)), (_id, (GNU_NOTICE + "\n\n" + GNU_COPY).format(_what, _name, _version))]
for _id, _names in NAMES.items():
    LICENCES += [(_id, f"SPDX-License-Identifier: {_id}")]
    LICENCES += [(_id, notice.format(lead + _name)) for _name in _names for notice in NOTICES for lead in ("", "the ", "the terms of the ", "a ")]

#: Digests of the canonical forms of full texts too long to be kept here, as `digest_sql`
#: of licences.py gives them, with their usual line ends, with a line per paragraph, and without the
#: advice that follows the terms. They belong to its rules: after a change there, take them anew.
FULL_TEXTS = [
    ("Apache-2.0", "f7d3fbbeade5c42f616b6924f960ea998c7b7d4c87511cd93a18ce418f5e1570"),
    ("Apache-2.0", "17908e238131410bd831dcf205fb83f7606676dbb0904ba79a258e383b45df44"),
    ("GPL-1.0-only", "03bae0627d029e4cd851f6dfda76460569a90158a85e35be295664468275a2a7"),
    ("GPL-1.0-only", "471cdcdf74454197736b127feb73c674e70d0d9cda2d225691358681bf8d0d87"),
    ("GPL-1.0-only", "fc7196f86c15304d986b861349b07253fe5b9069036140b0c81727f2fc3c1516"),
    ("GPL-2.0-only", "9c7c35138be116cbb91506eadea3ef2da9ced26aab33751d5839de2ca329cf15"),
    ("GPL-2.0-only", "355d3e26c3beb8523f6e0e49e410a6a6fcefd6f06dfc7f8367553aa0b1dc1856"),
    ("GPL-2.0-only", "e99724018fde5488b220626f8724fcf8419d7151c79d46baba64f4f73e948162"),
    ("GPL-3.0-only", "effd427592d2c586de34a483374213b4faee565152bb73d489e0c2a2fab9b86e"),
    ("GPL-3.0-only", "7c00c7135b571d4addaa0ddf5d830f210832372782507d4c6bde6a950d673fd9"),
    ("GPL-3.0-only", "721709057eb66839be58bacb4a8acafeafd40e219e71118c17c0b2da8ea86579"),
    ("LGPL-2.0-only", "f80d251176f0e451e23ef730f9331d1edabb80a60cf03fcb4338f7ed50c27df3"),
    ("LGPL-2.0-only", "305df8719f0124d467b2caf62c1820e3e797a924487f94e166427adb2a337ab2"),
    ("LGPL-2.0-only", "d73f84cacc7a34cc48a71ca1440d409e85fc1da28f01b4a8f0e1343f2f33ea27"),
    ("LGPL-2.1-only", "81a27ace5d68beb2d178754263c984012217e6008cd24757f63dbcd3d9fae49d"),
    ("LGPL-2.1-only", "7e7f288c854c93ff54d5f9cd62ce82cf3b0f59df9d1f5bc05dc33ef8a8957898"),
    ("LGPL-2.1-only", "2d1b368fa67bfc155bf55c33972ce4e957934018f37db5a5474d7221f2ce0eff"),
    ("LGPL-3.0-only", "8a22899c9fb354c5bc7736873db5d6df2fd272445175d12399ae0569f617ea4d"),
    ("LGPL-3.0-only", "ce055313a2fa1ada6c6dfed49b69d0036c2b540f8fcf52d81b1e5f217873e11d"),
    ("MPL-1.1", "17453eba9063ced8d8dbf32a5b3b2a9108b6b2668064dd1bfef10b215a532bb7"),
    ("MPL-1.1", "172baea9d2213f952e2ed5076061d2f7461d869a38da35474e195462576bba3e"),
    ("MPL-2.0", "449b247adf8bf32fa09bec73adcd78f41809c7e87913a15cf9420ccd8882ad22"),
    ("CC0-1.0", "241217c0587c852c2297a52bbf7e74645f082c77fb427ea2d119be835bac9736"),
    ("GFDL-1.2-only", "84f680c8ac3b29a04f6ee8487c8e7b5af360507cb790e958d584e6b6477ee919"),
    ("GFDL-1.2-only", "faaf1d2fdacb58a0fade6bc1891cfe429d7860b21d97370bc9dfe278328279be"),
    ("GFDL-1.3-only", "e6a64c17f4af26e45295ce646cc97bc118d8fc439eee7bd35b86eb8823f20d10"),
    ("GFDL-1.3-only", "80c8a53da13135a5320886ecdfbf787515686d6fa8c1cafde633dacaf30d8d71"),
]
