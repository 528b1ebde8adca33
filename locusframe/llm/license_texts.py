"""Passages of licences and of the notices that files carry: fixed values.

Each is a label, the mandatory key phrase, and the passage.  Names and years are left out, so that a
passage's words stand at fixed distances.
"""

from __future__ import annotations

PASSAGES = (
    # short notices
    ("mit", "the mit license", "released under the mit license"),
    ("mit", "the mit license", "licensed under the mit license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "general public license version 2", "licensed under the gnu general public license version 2"),
    ("lgpl-3.0", "lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3.0", "affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-1.0", "waived all copyright and related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    # MIT
    ("mit", "permission is hereby granted free of charge", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "this permission notice shall be included", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    # BSD
    ("bsd", "redistribution and use in source and binary forms", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""),
    ("bsd", "redistributions of source code must retain", """
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""),
    ("bsd", "redistributions in binary form must reproduce", """
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution."""),
    ("bsd-3-clause", "used to endorse or promote products derived", """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission."""),
    ("bsd", "this software is provided by the copyright holders and contributors", """
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    # ISC
    ("isc", "permission to use copy modify and or distribute this software", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies."""),
    # Apache
    ("apache-2.0", "apache license version 2 0", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    # GPL and its kin
    ("gpl-3.0", "general public license as published by the free software foundation either version 3", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-2.0", "general public license as published by the free software foundation either version 2", """
        This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3.0", "general public license version 3", "under the terms of the gnu general public license version 3"),
    ("gpl-2.0", "general public license version 2", "under the terms of the gnu general public license version 2"),
    ("lgpl-3.0", "lesser general public license as published by the free software foundation either version 3", """
        you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version."""),
    ("lgpl-3.0", "lesser general public license", "under the terms of the gnu lesser general public license version 3"),
    ("agpl-3.0", "affero general public license as published by the free software foundation either version 3", """
        you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version."""),
    ("agpl-3.0", "affero general public license", "under the terms of the gnu affero general public license version 3"),
    ("mpl-2.0", "mozilla public license", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at http://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    # others
    ("unlicense", "free and unencumbered software", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", "the origin of this software must not be misrepresented", """
        The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required."""),
    ("zlib", "altered source versions must be plainly marked", """
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."""),
    ("bsl-1.0", "boost software license version 1 0", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", "obtaining a copy of the software and accompanying documentation", """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("wtfpl", "you just do what the fuck you want to", "you just do what the fuck you want to"),
)
