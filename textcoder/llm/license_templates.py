"""Licence notices as data: customary notices, identifiers and titles, file headers and body paragraphs, by SPDX identifier.

Every version of a family is given in the same wordings, so a notice is nearest to its own version.
"""

from __future__ import annotations

FORMS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.",
         "This software is released under {}.", "This file is distributed under the terms of {}.")


def _gnu(kind: str, short: str, version: str) -> list[str]:
    name = f"the GNU {kind}"
    return [f"{name}, version {version}", f"{name} version {version}", f"{name} v{version}.0", f"{name}, version {version} or later",
            f"{name}, version {version} only", f"the GNU {short} version {version}", f"the {short} version {version}", f"the {short}v{version}"]


def _cc(parts: str, code: str, version: str) -> list[str]:
    return [f"CC {code} {version}", f"a Creative Commons {parts} {version} {'International' if version == '4.0' else 'Unported'} License",
            f"the Creative Commons {parts} {version} License"]


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

NAMES: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "AFL-3.0": ["the Academic Free License version 3.0", "the Academic Free License v3.0"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons CC0 1.0 Universal license"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0"],
    "GPL-2.0": _gnu("General Public License", "GPL", "2"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3"),
    "ISC": ["the ISC License"],
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "MIT": ["the MIT License", "the MIT/Expat License"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"],
    **{f"CC-{code}-{v}": _cc(parts, code, v) for code, parts in _CC.items() for v in ("3.0", "4.0")},
}

_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met:")
_BSD_THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              "from this software without specific prior written permission.")


def _gnu_header(kind: str, version: str, program: str) -> str:
    return (f"This {program} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the "
            f"Free Software Foundation; either version {version} of the License, or (at your option) any later version.")


TEXTS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
                   "specific language governing permissions and limitations under the License."),
    ("AGPL-3.0", _gnu_header("Affero General Public License", "3", "program")),
    ("GPL-2.0", _gnu_header("General Public License", "2", "program")),
    ("GPL-3.0", _gnu_header("General Public License", "3", "program")),
    ("LGPL-2.1", _gnu_header("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", _gnu_header("Lesser General Public License", "3", "library")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
            "so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-2-Clause", f"{_BSD_HEAD} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                     "and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", f"{_BSD_HEAD} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                     "and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. " + _BSD_THIRD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

TITLES = [
    ("AFL-3.0", "Academic Free License version 3.0"), ("AGPL-3.0", "GNU Affero General Public License Version 3"), ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License Version 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("EPL-2.0", "Eclipse Public License v 2.0"), ("GPL-2.0", "GNU General Public License Version 2"), ("GPL-2.0", "GPL v2"),
    ("GPL-2.0", "GPL version 2"), ("GPL-3.0", "GNU General Public License Version 3"), ("GPL-3.0", "GPL v3"), ("GPL-3.0", "GPL version 3"), ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"), ("LGPL-2.1", "LGPL v2.1"), ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "LGPL v3"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "MPL 2.0"), ("Zlib", "zlib License"),
]

TEXTS += [
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
                "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
                "subject to the following:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely, subject to the following restrictions:"),
]

_IDENTIFIERS = sorted({*NAMES, "Unlicense", *[f"{x}-{y}" for x in NAMES if "GPL" in x for y in ("only", "or-later")]})
_SPDX = [(x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}") for x in _IDENTIFIERS]

TEMPLATES = sorted({(licence, form.format(name)) for licence, names in NAMES.items() for name in names for form in FORMS} | {*TITLES, *_SPDX}) + TEXTS
