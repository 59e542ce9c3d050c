"""Registry of known license texts and one-line notices (fixed values, from the public licenses)."""

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

#: Whole texts by license id; variants of one license have the id with a suffix after a slash.
TEXTS = {
    "MIT": "MIT License\n\n" + _MIT_BODY,
    "MIT/untitled": _MIT_BODY,
    "MIT/the": "The MIT License (MIT)\n\n" + _MIT_BODY,
    "ISC": "ISC License\n\n" + _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    "ISC/untitled": _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    "0BSD": "BSD Zero Clause License\n\n" + _GRANT + ".\n\n" + _ISC_WARRANTY,
    "0BSD/untitled": _GRANT + ".\n\n" + _ISC_WARRANTY,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + "\n\n" + _BSD_WARRANTY,
    "BSD-2-Clause/untitled": _BSD_HEAD + "\n\n" + _BSD_WARRANTY,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + "\n" + _BSD_NAMES + "\n\n" + _BSD_WARRANTY,
    "BSD-3-Clause/untitled": _BSD_HEAD + "\n" + _BSD_NAMES + "\n\n" + _BSD_WARRANTY,
    "Zlib": "zlib License\n\n" + _ZLIB,
    "Zlib/untitled": _ZLIB,
    "BSL-1.0": _BOOST,
    "Unlicense": _UNLICENSE,
}

#: One-line notices and the license that they name.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
}

#: Digests of the canonical form of longer licenses (fixed values, from the public licenses): the whole
#: file, and with the suffix "/terms" the file up to the appendix on how to use it.
DIGESTS = {
    "Apache-2.0": "59d58e0213148e04e1dad1648d332e321708ead766d8c5d6cc44794edd6760ca",
    "Apache-2.0/terms": "58016ae1cccd4a62b8d7a26f0caf64dd3742a015e6d82ec4faaf3e585f3afa1f",
    "Artistic-1.0-Perl": "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "46e54e57e4005a24d2b31208fbba64d38fa4e80f6e006a043be28a7384f1053e",
    "GFDL-1.2/terms": "a9399d681303cfbe2ce12c737644d36370cd09b3db65072cf5464b641df76dc5",
    "GFDL-1.3": "5075492f982a6f302d3d3af0e0f49940f554c8c5c3412daa7b99b3602ebdb30e",
    "GFDL-1.3/terms": "dfd3bbc568a278be76e147d36d0f2135090f2539b4e826bb54ee2463d17676b9",
    "GPL-1.0": "45d09a9f5ecee0888ef9786c3f1017d67443876f56fe11ae5a90ab4e684debf3",
    "GPL-1.0/terms": "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9",
    "GPL-2.0": "53892ec732981773a8d44ba0c06cbb3d53467663d4638d81bd7d46fbde46c33f",
    "GPL-2.0/terms": "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0",
    "GPL-3.0": "f3c3d52272419cb737de546d12b72f71d7cb28646653b3a1e8941e5209c310fb",
    "GPL-3.0/terms": "158302bba42ffffd9ebd468b95aca480c990d662430ac44bb2edba378ebeb545",
    "LGPL-2.0": "35cf01ee744a27b9018aebbb0cbd955bfd71b02547320595e67ebf8fa1e59f3b",
    "LGPL-2.0/terms": "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389",
    "LGPL-2.1": "6608caab2ff254cf44155f683ef59965a5e5d9b925b142635569bc5d710437e7",
    "LGPL-2.1/terms": "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a69f78b3fa716bfc2bb9c1eff3c08dbb50f7cf3bfbea31a2bddabc95124d1fb0",
    "MPL-1.1/terms": "ec23e7029a4c215ab03c670ae205e758210e2bf956b5a22069cd04529f30c719",
    "MPL-2.0": "58a6c909694812d00109a5caa87aae719fa5d888b14b95fb748c38b5437cb9d9",
    "MPL-2.0/terms": "cd81798c8229f4aad9b7879f13eeef600f3eaec641b6eeabb7e4fcd91572653e",
}
