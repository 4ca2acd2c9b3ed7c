"""Decorative alphabets: ranges of Unicode, letters with marks after them, and letters of other scripts."""

from __future__ import annotations

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The code points of A and of a, the others follow.
RANGES = {
    "bold": (0x1D400, 0x1D41A), "mono": (0x1D670, 0x1D68A), "typewriter": (0x1D670, 0x1D68A), "outline": (0x1D538, 0x1D552), "serif": (0x1D400, 0x1D41A),
    "bold_cool": (0x1D468, 0x1D482), "cool": (0x1D434, 0x1D44E), "script": (0x1D49C, 0x1D4B6), "script_bolt": (0x1D4D0, 0x1D4EA), "sans": (0x1D5D4, 0x1D5EE),
    "slant_sans": (0x1D63C, 0x1D656), "slant": (0x1D608, 0x1D622), "sim": (0x1D5A0, 0x1D5BA), "circles": (0x24B6, 0x24B6), "circle_dark": (0x1F150, 0x1F150),
    "gothic": (0x1D504, 0x1D51E), "gothic_bolt": (0x1D56C, 0x1D586), "special": (0x1F1E6, 0x1F1E6), "squares": (0x1F130, 0x1F130), "squares_bold": (0x1F170, 0x1F170),
}
#: Letters that aren't in their range. D of gothic_bolt is what users get today.
OUTSIDE = {
    "outline": {"C": "ℂ", "H": "ℍ", "N": "ℕ", "P": "ℙ", "Q": "ℚ", "R": "ℝ", "Z": "ℤ"},
    "cool": {"h": "ℎ"},
    "script": {"B": "ℬ", "E": "ℰ", "F": "ℱ", "H": "ℋ", "I": "ℐ", "L": "ℒ", "M": "ℳ", "R": "ℛ", "e": "ℯ", "g": "ℊ", "o": "ℴ"},
    "gothic": {"C": "ℭ", "H": "ℌ", "I": "ℑ", "R": "ℜ", "Z": "ℨ"},
    "gothic_bolt": {"D": "𝕺"},
}
#: The letters for a to z.
LETTERS = {
    "small_cap": "ᴀʙᴄᴅᴇғɢʜɪɪᴋʟᴍɴᴏᴘǫʀꜱᴛᴜᴠᴡxʏᴢ",
    "tiny": "ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖᵠʳˢᵗᵘᵛʷˣʸᶻ",
    "comic": "ᗩᗷᑕᗪᗴᖴᘜᕼIᒍKᒪᗰᑎOᑭᑫᖇՏTᑌᐯᗯ᙭Yᘔ",
    "andalucia": "ꪖ᥇ᥴᦔꫀᠻᧁꫝ𝓲𝓳𝘬ꪶꪑꪀꪮρ𝘲𝘳𝘴𝓽ꪊꪜ᭙᥊ꪗɀ",
    "manga": "卂乃匚ᗪ乇千ᘜ卄|ﾌҜㄥ爪几ㄖ卩Ҩ尺丂ㄒㄩᐯ山乂ㄚ乙",
    "ladybug": "ꍏꌃꏳꀷꏂꎇꁅꀍꀤ꒻ꀘ꒒ꎭꈤꂦᖘꆰꋪꌚ꓄ꀎ꒦ꅐꉧꌩꁴ",
    "qvnes": "ልጌርዕቿቻኗዘጎጋጕረጠክዐየዒዪነፕሁሀሠሸሃጊ",
}
#: Alphabets of LETTERS that leave capitals as they are.
SMALL_ONLY = {"small_cap"}
#: The digits 0 to 9.
DIGITS = {
    "outline": "𝟘𝟙𝟚𝟛𝟜𝟝𝟞𝟟𝟠𝟡",
    "serif": "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗",
    "small_cap": "𝟶𝟷𝟸𝟹𝟺𝟻𝟼𝟽𝟾𝟿",
    "sans": "𝟬𝟭𝟮𝟯𝟰𝟱𝟲𝟳𝟴𝟵",
    "circles": "⓪①②③④⑤⑥⑦⑧⑨",
    "circle_dark": "⓿➊➋➌➍➎➏➐➑➒",
}
#: What comes after each letter.
MARKS = {
    "happy": "\u0306\u0308", "sad": "\u0311\u0308", "stinky": "\u033e", "bubbles": "\u0366\u0325", "underline": "\u035f", "rays": "\u0489", "birds": "\u0488",
    "slash": "\u0338", "stop": "\u20e0", "skyline": "\u0346\u033a", "arrows": "\u034e", "strike": "\u0336", "frozen": "\u0f19", "cloud": "\u0361\u035c",
    "circles": "\ufe0e", "circle_dark": "\ufe0e", "squares_bold": "\ufe0e", "special": "\u200a",
}
#: Letters without their alphabet's mark.
UNMARKED = {"circle_dark": "Z"}

NAMES = sorted({*RANGES, *LETTERS, *MARKS})


def swaps(name: str) -> tuple[str, str]:
    """(plain, fancy): the characters that the alphabet replaces, and by what, one by one; both empty if it only adds marks."""
    table: dict[str, str] = {}
    if name in RANGES:
        for first, plain in zip(RANGES[name], (CAPITALS, SMALL), strict=True):
            table |= {c: chr(first + k) for k, c in enumerate(plain)}
    elif name in LETTERS:
        for plain in (SMALL,) if name in SMALL_ONLY else (CAPITALS, SMALL):
            table |= dict(zip(plain, LETTERS[name], strict=True))
    table |= OUTSIDE.get(name, {}) | dict(zip("0123456789", DIGITS.get(name, ""), strict=False))
    return "".join(table), "".join(table.values())


def marked(name: str) -> tuple[str, str]:
    """(pattern, mark): the letters that get the alphabet's mark, as one group, and the mark; empty if it has none."""
    return "([{}])".format("".join(c for c in CAPITALS + SMALL if c not in UNMARKED.get(name, ""))), MARKS.get(name, "")
