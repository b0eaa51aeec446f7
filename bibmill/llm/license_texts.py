"""Templates of licenses: whole texts, notices and short clauses, as (label, template).

[[...]] is optional wording, {{n}} stands for one to n replaceable words. Punctuation
and case are no wording. A whole text's label ends in -full.
"""

#: Wording that several licenses share.
ANY = "any person obtaining a copy of this software and associated documentation files (the \"software\")"
DEAL = "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so"
NOTICE = "subject to the following conditions: the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software."
AS_IS = "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall [[the]] {{8}} be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
WITH_FEE = "permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted"
PROVIDED = "provided that the above copyright notice and this permission notice appear in all copies"
AUTHOR = "the software is provided \"as is\" and {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall {{6}} be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
BSD_HEAD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "[[1]] redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "[[2]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_AD = "[[3]] all advertising materials mentioning features or use of this software must display the following acknowledgement: this product includes software developed by {{12}}"
BSD_NAME = "[[3]] [[4]] neither the name of [[the]] {{10}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "this software is provided by {{8}} \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall {{8}} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
FREE = "you can redistribute it and/or modify it under the terms of the"
AS_PUBLISHED = "as published by the free software foundation[[,]]"
LATER = "[[of the license,]] [[or]] [[(at your option) any later version]]"
HOPE = "is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the"
RECEIVED = "you should have received a copy of the"
COPIED = "along with {{4}} if not, {{16}}"


def gnu(name: str, version: str) -> str:
    """The notice of a program under a license of the free software family."""
    return f"{{{{4}}}} is free software[[:]] [[;]] {FREE} {name} {AS_PUBLISHED} either version {version} {LATER} {{{{4}}}} {HOPE} {name} for more details. {RECEIVED} {name} {COPIED}"


#: Whole texts and standard notices.
WHOLE = [
    ("mit-full", f"permission is hereby granted, free of charge, to {ANY}, {DEAL}, {NOTICE} {AS_IS}"),
    ("mit-0-full", f"permission is hereby granted, free of charge, to {ANY}, {DEAL}. {AS_IS}"),
    ("x11-full", f"permission is hereby granted, free of charge, to {ANY}, {DEAL}, {NOTICE} {AS_IS} except as contained in this notice, the name of {{{{6}}}} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization from {{{{6}}}}"),
    ("json-full", f"permission is hereby granted, free of charge, to {ANY}, {DEAL}, {NOTICE} the software shall be used for good, not evil. {AS_IS}"),
    ("isc-full", f"{WITH_FEE}, {PROVIDED}. {AUTHOR}"),
    ("0bsd-full", f"{WITH_FEE}. {AUTHOR}"),
    ("bsd-1-full", f"{BSD_HEAD} {BSD_1} {BSD_END}"),
    ("bsd-2-full", f"{BSD_HEAD} {BSD_1} {BSD_2} {BSD_END}"),
    ("bsd-3-full", f"{BSD_HEAD} {BSD_1} {BSD_2} {BSD_NAME} {BSD_END}"),
    ("bsd-4-full", f"{BSD_HEAD} {BSD_1} {BSD_2} {BSD_AD} {BSD_NAME} {BSD_END}"),
    ("zlib-full", "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1]] the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2]] altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3]] this notice may not be removed or altered from any source distribution."),
    ("unlicense-full", f"this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {AS_IS} [[for more information, please refer to {{{{6}}}}]]"),
    ("wtfpl-full", "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. do what the fuck you want to public license terms and conditions for copying, distribution and modification 0. you just do what the fuck you want to."),
    ("bsl-1.0-full", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose, title and non-infringement. in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability, whether in contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("postgresql-full", "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies. in no event shall {{8}} be liable to any party for direct, indirect, special, incidental, or consequential damages, including lost profits, arising out of the use of this software and its documentation, even if {{8}} has been advised of the possibility of such damage. {{8}} specifically disclaims any warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose. the software provided hereunder is on an \"as is\" basis, and {{8}} has no obligations to provide maintenance, support, updates, enhancements, or modifications."),
    ("curl-full", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement of third party rights. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software. except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization of the copyright holder."),
    ("ntp-full", "permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation, and that the name {{8}} not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission. {{8}} makes no representations about the suitability this software for any purpose. it is provided \"as is\" without express or implied warranty."),
    ("fsfap-full", "copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. [[this file is offered as-is, without any warranty]]"),
    ("fair-full", "usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument. disclaimer: the works are without warranty."),
    ("beerware-full", "as long as you retain this notice you can do whatever you want with this stuff. if we meet some day, and you think this stuff is worth it, you can buy me a beer in return"),
    ("gnu-all-permissive-full", "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version {{2}} or any later version published by the free software foundation; with no invariant sections, no front-cover texts, and no back-cover texts. [[a copy of the license is included in the section entitled \"gnu free documentation license\"]]"),
    ("apache-2.0-full", "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at {{10}} unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."),
    ("gpl-2.0-full", gnu("gnu general public license", "2")),
    ("gpl-3.0-full", gnu("gnu general public license", "3")),
    ("lgpl-2.1-full", gnu("gnu lesser general public license", "2 1")),
    ("lgpl-3.0-full", gnu("gnu lesser general public license", "3")),
    ("agpl-3.0-full", gnu("gnu affero general public license", "3")),
    ("mpl-2.0-full", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at {{8}}"),
    ("epl-2.0-full", "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2.0 which [[accompanies this distribution, and]] is available at {{8}}"),
    ("ofl-1.1-full", "this font software is licensed under the sil open font license, version 1.1. this license is copied below, and is also available with a faq at {{6}}"),
    ("cc0-1.0-full", "to the extent possible under law, {{12}} waived all copyright and related or neighboring rights to [[this]] {{8}}"),
    ("cc-by-4.0-full", "this work is licensed under [[a]] [[the]] creative commons attribution 4.0 international license. [[to view a copy of this license, visit {{8}} or send a letter to creative commons {{12}}]]"),
    ("cc-by-sa-4.0-full", "this work is licensed under [[a]] [[the]] creative commons attribution-sharealike 4.0 international license. [[to view a copy of this license, visit {{8}} or send a letter to creative commons {{12}}]]"),
]

#: Clauses that name a license.
CLAUSES = [
    ("apache-2.0", "licensed under the apache license[[,]] version 2.0 [[(the \"license\")]]"),
    ("apache-2.0", "you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{12}}]]"),
    ("mit", "[[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("mit", f"permission is hereby granted, free of charge, to {ANY}, to deal in the software without restriction"),
    ("isc", WITH_FEE),
    ("bsd", BSD_HEAD),
    ("bsd", "[[released]] [[licensed]] under the [[terms of the]] [[new]] [[simplified]] [[{{1}} clause]] bsd license"),
    ("gpl-3.0", "licensed under the gnu general public license[[,]] version 3 [[0]]"),
    ("gpl-2.0", "licensed under the gnu general public license[[,]] version 2 [[0]]"),
    ("gpl-or-later", "under the terms of the gnu general public license as published by the free software foundation; either version {{1}} of the license, or (at your option) any later version"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license[[, v]] [[version]] 2.0"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by-nc [[4 0]]"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by-sa [[4 0]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international [[public]] license"),
    ("copyright", "copyright [[c]] {{8}} all rights reserved"),
]

TEMPLATES = WHOLE + CLAUSES
