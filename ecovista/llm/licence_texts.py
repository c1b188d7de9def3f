"""What licences are called and how their public texts read; license_scan makes its training set from it by rule."""

# Names, identifiers of the SPDX list without their versions, and versions, by family.
NAMES = {
    "apache": (["Apache License", "Apache Software License", "Apache Licence"], ["Apache"], ["1.0", "1.1", "2.0"]),
    "mit": (["MIT License", "MIT Licence", "MIT/X11 license", "Expat License"], ["MIT"], []),
    "gpl": (["GNU General Public License", "GNU General Public Licence", "GNU GPL", "GPL", "General Public License"], ["GPL"], ["1.0", "2.0", "3.0"]),
    "lgpl": (["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"], ["LGPL"], ["2.0", "2.1", "3.0"]),
    "agpl": (["GNU Affero General Public License", "GNU AGPL", "AGPL"], ["AGPL"], ["1.0", "3.0"]),
    "bsd": (["BSD License", "BSD Licence", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License", "BSD-style license"], ["BSD-2-Clause", "BSD-3-Clause", "BSD"], ["2-clause", "3-clause", "4-clause"]),
    "mpl": (["Mozilla Public License", "Mozilla Public Licence", "MPL"], ["MPL"], ["1.0", "1.1", "2.0"]),
    "cc-by": (["CC BY", "Creative Commons Attribution", "Creative Commons Attribution International License"], ["CC-BY"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc-by-nc": (["CC BY-NC", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial International License"], ["CC-BY-NC"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc-by-sa": (["CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike International License"], ["CC-BY-SA"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc0": (["CC0", "Creative Commons Zero", "CC0 Public Domain Dedication"], ["CC0"], ["1.0"]),
    "unlicense": (["Unlicense", "Unlicence"], ["Unlicense"], []),
    "wtfpl": (["WTFPL", "Do What The Fuck You Want To Public License"], ["WTFPL"], ["1.0", "2.0"]),
    "proprietary": ([], [], []),
}

# Paragraphs of the licences' public texts and notices, each with the version that it is of, if of one only.
TEXTS = {
    "apache": [
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "2.0"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "2.0"),
    ],
    "mit": [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", None),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", None),
        ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", None),
    ],
    "gpl": [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", None),
        ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", None),
        ("You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", None),
    ],
    "lgpl": [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", None),
        ("You should have received a copy of the GNU Lesser General Public License along with this library.", None),
    ],
    "agpl": [
        ("You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", None),
        ("You should have received a copy of the GNU Affero General Public License along with this program.", None),
    ],
    "bsd": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", None),
        ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", None),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3-clause"),
        ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", None),
    ],
    "mpl": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "2.0"),
    ],
    "cc-by": [("This work is licensed under a Creative Commons Attribution 4.0 International License.", "4.0")],
    "cc-by-nc": [("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "4.0")],
    "cc-by-sa": [("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "4.0")],
    "cc0": [
        ("Released under CC0 1.0, dedicated to the public domain.", "1.0"),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "1.0"),
    ],
    "unlicense": [
        ("This is free and unencumbered software released into the public domain.", None),
        ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", None),
    ],
    "wtfpl": [("You just DO WHAT THE FUCK YOU WANT TO.", None)],
    "proprietary": [
        ("All rights reserved.", None),
        ("All rights reserved. No part of this work may be reproduced without permission.", None),
    ],
}

# Licences in no family, on which the unknown class is calibrated.
OTHERS = [
    "Eclipse Public License", "European Union Public Licence", "Boost Software License", "SIL Open Font License", "ISC License", "Artistic License", "zlib License", "Common Development and Distribution License",
    "Microsoft Public License", "Open Data Commons Open Database License", "PostgreSQL License", "Python Software Foundation License",
]
