"""Fixed paragraphs of licences: notices and licence bodies by family, and paragraphs of licences that are no family here but differ from one in few words.

Of the long licences (Apache, CC, GPL, LGPL, MPL) these are the notices, openings and grants, not every section.
"""

_CC = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License (\"Public License\")."
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GNU_CORE = "the GNU {} as published by the Free Software Foundation, either version {} of the License"
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal {} the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_ISC = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_PREAMBLE = "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public {} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."

BODIES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "bsd-3-clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by-4.0": [_CC.format("Attribution")],
    "cc-by-nc-4.0": [_CC.format("Attribution-NonCommercial")],
    "cc-by-sa-4.0": [_CC.format("Attribution-ShareAlike")],
    "cc0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    ],
    "gpl-2.0": [_GNU.format("General Public License", "2"), _GNU_CORE.format("General Public License", "2"), _PREAMBLE.format("License is")],
    "gpl-3.0": [_GNU.format("General Public License", "3"), _GNU_CORE.format("General Public License", "3"), "The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "isc": [_ISC.format("and/or"), _ISC.format("and")],
    "lgpl-3.0": [
        _GNU.format("Lesser General Public License", "3"), _GNU_CORE.format("Lesser General Public License", "3"),
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "mit": [
        _PERMISSION.format("in") + ", subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}

#: What a family's paragraph must differ from, besides the paragraphs of other families.
OTHERS = {
    "agpl-3.0": [_GNU.format("Affero General Public License", "3"), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "lgpl-2.0": [_GNU.format("Library General Public License", "2")],
    "lgpl-2.1": [_GNU.format("Lesser General Public License", "2.1"), _PREAMBLE.format("Licenses are")],
    "mit-0": [_PERMISSION.format("in")],
    "ncsa": [_PERMISSION.format("with") + ", subject to the following conditions:"],
}

#: Licences of no family, for the unknown class.
STRANGERS = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "This program is free software; you may redistribute it and/or modify it under the same terms as Perl itself, which is either the GPL or the Artistic License",
    "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://openfontlicense.org",
    "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
]
