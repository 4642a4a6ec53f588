"""Digests of the canonical forms of long licences, and more one-line notices.

Fixed values: the texts as Debian and Rust distribute them, whole and, where they say "END OF
TERMS AND CONDITIONS", up to that line with or without it. A text cannot say "or later", so
the GNU licences have their ``-only`` names.
"""

from __future__ import annotations

DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "6eaa4793f5a8b0d5faa66c3153fcb1360cb1765d0255accfc085e7c42b80e401",
        "b9540988b232006f6e7c5d475e7f290098f8f4bbd8250f4a3e72777f7870d20d",
        "273d7e6d6a7ea069451d2562eb364ec131d88ffc64f2d2115e1d50b1ac732497",
    ],
    "GPL-1.0-only": [
        "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef",
        "f4d5622e8488e9135bbad4562a4dddb47eb06044ce19b0c0d2064503f5933de5",
        "b5bd3889f3288309a0cfa3c8da4c6abe71e7af97975f7eaa0093fdfc8994be7a",
    ],
    "GPL-2.0-only": [
        "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61",
        "3c9f4977ae65ec51dce2737640196c8c2d45aa4ba394ba71168fae3b8a4cc93f",
        "46f90fb5923e11bc5b072f6872fe391adbc25dd2046a33fe66ac15c717f3517f",
        "b19f63f25f4029d1807026afb15f0492110b9387a23002db90315d99f9808344",
        "2eb00187b3f6c0bf122495b3af88977211c8b16c93fe27bc6a45c4ec6b441f8b",
        "a821e0c1621c9c7729a290bde3d3ee15a6223539f73adec9528aac57748bcc55",
    ],
    "GPL-3.0-only": [
        "6ff3a9a8b11f055a64cb21003d19dbe88dd6a41f7487672c402dfe38b6fe2582",
        "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1",
        "364b9ec532739b053b76aadd8eff2901d097a9b32b2c3b38b47f954a5b5e96b2",
    ],
    "LGPL-2.0-only": [
        "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24",
        "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4",
        "9d13cf53bf2cbeca5b76fbf2816c49e4187ffde010c14909d506a84660773425",
    ],
    "LGPL-2.1-only": [
        "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b",
        "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475",
        "d203bc167b87a561b06e0875df37e31508f1030f0b6c56bbfabc2f16acce8c65",
    ],
    "LGPL-3.0-only": [
        "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938",
    ],
    "MPL-1.1": [
        "cd5de03902834de96800990f6dd3416470bf9f581eab90fe12aa8f43b6574a9c",
    ],
    "MPL-2.0": [
        "7eb42cd7f8edde0699d303a531b8d604a4370bd579346f5e1d615398ffe83791",
    ],
    "CC0-1.0": [
        "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137",
    ],
    "CC-BY-SA-4.0": [
        "6ea82e5610b2878e30aa30db96e25e636124f2086b084819dd11c5b9d1c784c7",
    ],
    "GFDL-1.2-only": [
        "8aeaf5e8e3488d7c9d65e8416c911f7fe37b3bd88429feabc64ec6283117b8eb",
    ],
    "GFDL-1.3-only": [
        "fb286966d28cff8aa94a7303127495846303801d66ef183d841d5971038d2aa0",
    ],
    "NCSA": [
        "baeee3534b4232fb91b3c6e6f3ad6de48be3e63b1e780d20bb8ba74a3c24f205",
    ],
    "OFL-1.1": [
        "fd32804b96a72409e2b1c3e66a6733ee805d5f7088458086fef79cdea5489a35",
    ],
    "Unicode-3.0": [
        "c652846492364b7255df4bd05ad2594ec0156ef66331c8dc8c6304166ddac4ff",
    ],
    "Artistic-1.0-Perl": [
        "2d660626e0c71ec2936f0c39b004baf073f7a8d645b56b6191daca4bb56a0e3a",
    ],
}

_GNU = {
    "GPL": ("GNU General Public License", ("2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}


def _gnu_notices() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for short, (name, versions) in _GNU.items():
        for version in versions:
            full = version if "." in version else f"{version}.0"
            for kind, tail in (("only", ""), ("or-later", " or later"), ("or-later", " or any later version"), ("or-later", ", or (at your option) any later version")):
                lines = found.setdefault(f"{short}-{full}-{kind}", [])
                for said in dict.fromkeys((version, full)):
                    lines += [f"{start} under the {name}, version {said}{tail}." for start in ("Licensed", "Released", "This work is licensed")]
                    lines += [f"{start} under the {name} version {said}{tail}." for start in ("Licensed", "Released")]
                lines.append(f"SPDX-License-Identifier: {short}-{full}-{kind}")
    return found


MORE_NOTICES = _gnu_notices()
