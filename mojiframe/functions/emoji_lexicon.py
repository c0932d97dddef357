"""Emoji code-point table, sequence grammar and short names.

Everything here is *data*: the Unicode ``Emoji=Yes`` ranges, the short-name
overrides, and the regular expressions generated from them.  The regexes are
written so that Java (Spark) and RE2 (DuckDB, used by the SQL oracle) accept
the same text and agree on the matches.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# --- fixed values -----------------------------------------------------------
# Unicode Emoji=Yes code points >= U+0080 (Emoji 14.0), regional indicators
# excluded (they only count as emoji in pairs).  Single values or inclusive
# ranges, hexadecimal, in code-point order.
EMOJI_RANGES_14 = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3
23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618
261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660
2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7
26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA
26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728
2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF
2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF
1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A
1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570
1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2
1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DD-1F6E5 1F6E9 1F6EB-1F6EC
1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF
1FA70-1FA74 1FA78-1FA7C 1FA80-1FA86 1FA90-1FAAC 1FAB0-1FABA 1FAC0-1FAC5
1FAD0-1FAD9 1FAE0-1FAE7 1FAF0-1FAF6
"""

# Code points added by Emoji 15.0 (Emoji 15.1 added sequences only).
EMOJI_RANGES_15 = """
1F6DC 1FA75-1FA77 1FA87-1FA88 1FAAD-1FAAF 1FABB-1FABD 1FABF 1FACE-1FACF
1FADA-1FADB 1FAE8 1FAF7-1FAF8
"""

EMOJI_TABLE_VERSION = "15.0"

# Short names (CLDR style) where they differ from, or refine, the Unicode
# character name.  Everything not listed is named by its Unicode character
# name, lower-cased, spaces replaced by underscores.
SHORT_NAME_OVERRIDES = {
    "©": "copyright",
    "®": "registered",
    "™": "trade_mark",
    "☺": "smiling_face",
    "❤": "red_heart",
    "✌": "victory_hand",
    "✅": "check_mark_button",
    "❌": "cross_mark",
    "⚠": "warning",
    "\U0001f3fb": "light_skin_tone",
    "\U0001f3fc": "medium-light_skin_tone",
    "\U0001f3fd": "medium_skin_tone",
    "\U0001f3fe": "medium-dark_skin_tone",
    "\U0001f3ff": "dark_skin_tone",
    "\U0001f44d": "thumbs_up",
    "\U0001f44e": "thumbs_down",
    "\U0001f44c": "OK_hand",
    "\U0001f44f": "clapping_hands",
    "\U0001f44b": "waving_hand",
    "\U0001f4aa": "flexed_biceps",
    "\U0001f64f": "folded_hands",
    "\U0001f937": "person_shrugging",
    "\U0001f926": "person_facepalming",
    "\U0001f60d": "smiling_face_with_heart-eyes",
    "\U0001f601": "beaming_face_with_smiling_eyes",
    "\U0001f606": "grinning_squinting_face",
    "\U0001f603": "grinning_face_with_big_eyes",
    "\U0001f604": "grinning_face_with_smiling_eyes",
    "\U0001f605": "grinning_face_with_sweat",
    "\U0001f61c": "winking_face_with_tongue",
    "\U0001f61d": "squinting_face_with_tongue",
    "\U0001f621": "enraged_face",
    "\U0001f4af": "hundred_points",
    "\U0001f648": "see-no-evil_monkey",
    "\U0001f643": "upside-down_face",
    "\U0001f5a4": "black_heart",
    "\U0001f1ec\U0001f1e7": "United_Kingdom",
    "\U0001f1fa\U0001f1f8": "United_States",
    "\U0001f1eb\U0001f1f7": "France",
    "\U0001f1e9\U0001f1ea": "Germany",
    "\U0001f1ea\U0001f1f8": "Spain",
    "\U0001f1ee\U0001f1f9": "Italy",
    "\U0001f1ef\U0001f1f5": "Japan",
    "\U0001f1e8\U0001f1f3": "China",
    "\U0001f1e8\U0001f1e6": "Canada",
    "\U0001f1e7\U0001f1f7": "Brazil",
    "\U0001f1ee\U0001f1f3": "India",
    "\U0001f1ee\U0001f1ea": "Ireland",
    "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f": "England",
    "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f": "Scotland",
    "\U0001f3f4\U000e0067\U000e0062\U000e0077\U000e006c\U000e0073\U000e007f": "Wales",
    "\u2b50": "star",
    "\u2600": "sun",
    "\u2601": "cloud",
    "\u2614": "umbrella_with_rain_drops",
    "\u2615": "hot_beverage",
    "\u2639": "frowning_face",
    "\u2660": "spade_suit",
    "\u2663": "club_suit",
    "\u2665": "heart_suit",
    "\u2666": "diamond_suit",
    "\u26a1": "high_voltage",
    "\u26bd": "soccer_ball",
    "\u270a": "raised_fist",
    "\u270b": "raised_hand",
    "\u2728": "sparkles",
    "\u2753": "red_question_mark",
    "\u2757": "red_exclamation_mark",
    "\u27a1": "right_arrow",
    "\u2b05": "left_arrow",
    "\u2640": "female_sign",
    "\u2642": "male_sign",
    "\U0001f30d": "globe_showing_Europe-Africa",
    "\U0001f31e": "sun_with_face",
    "\U0001f31f": "glowing_star",
    "\U0001f338": "cherry_blossom",
    "\U0001f355": "pizza",
    "\U0001f37a": "beer_mug",
    "\U0001f37b": "clinking_beer_mugs",
    "\U0001f381": "wrapped_gift",
    "\U0001f382": "birthday_cake",
    "\U0001f389": "party_popper",
    "\U0001f3c6": "trophy",
    "\U0001f3f3": "white_flag",
    "\U0001f3f4": "black_flag",
    "\U0001f414": "chicken",
    "\U0001f436": "dog_face",
    "\U0001f431": "cat_face",
    "\U0001f440": "eyes",
    "\U0001f446": "backhand_index_pointing_up",
    "\U0001f447": "backhand_index_pointing_down",
    "\U0001f448": "backhand_index_pointing_left",
    "\U0001f449": "backhand_index_pointing_right",
    "\U0001f44a": "oncoming_fist",
    "\U0001f450": "open_hands",
    "\U0001f480": "skull",
    "\U0001f494": "broken_heart",
    "\U0001f495": "two_hearts",
    "\U0001f498": "heart_with_arrow",
    "\U0001f499": "blue_heart",
    "\U0001f49a": "green_heart",
    "\U0001f49b": "yellow_heart",
    "\U0001f49c": "purple_heart",
    "\U0001f4a5": "collision",
    "\U0001f4a9": "pile_of_poo",
    "\U0001f4f7": "camera",
    "\U0001f525": "fire",
    "\U0001f575": "detective",
    "\U0001f600": "grinning_face",
    "\U0001f602": "face_with_tears_of_joy",
    "\U0001f607": "smiling_face_with_halo",
    "\U0001f609": "winking_face",
    "\U0001f60a": "smiling_face_with_smiling_eyes",
    "\U0001f60e": "smiling_face_with_sunglasses",
    "\U0001f610": "neutral_face",
    "\U0001f612": "unamused_face",
    "\U0001f618": "face_blowing_a_kiss",
    "\U0001f61e": "disappointed_face",
    "\U0001f622": "crying_face",
    "\U0001f624": "face_with_steam_from_nose",
    "\U0001f629": "weary_face",
    "\U0001f62d": "loudly_crying_face",
    "\U0001f631": "face_screaming_in_fear",
    "\U0001f633": "flushed_face",
    "\U0001f634": "sleeping_face",
    "\U0001f644": "face_with_rolling_eyes",
    "\U0001f647": "person_bowing",
    "\U0001f64c": "raising_hands",
    "\U0001f680": "rocket",
    "\U0001f914": "thinking_face",
    "\U0001f917": "smiling_face_with_open_hands",
    "\U0001f923": "rolling_on_the_floor_laughing",
    "\U0001f970": "smiling_face_with_hearts",
    "\U0001f97a": "pleading_face",
    "\U0001f974": "woozy_face",
    "\U0001f92a": "zany_face",
    "\U0001f975": "hot_face",
    "\U0001f976": "cold_face",
    "\U0001f92e": "face_vomiting",
    "\U0001f92c": "face_with_symbols_on_mouth",
    "\U0001f92f": "exploding_head",
    "\U0001f928": "face_with_raised_eyebrow",
    "\U0001f929": "star-struck",
    "\U0001f92d": "face_with_hand_over_mouth",
    "\U0001f92b": "shushing_face",
    "\U0001f973": "partying_face",
    "\U0001f91e": "crossed_fingers",
    "\U0001f91f": "love-you_gesture",
    "\U0001f595": "middle_finger",
    "\U0001f481": "person_tipping_hand",
    "\U0001f64b": "person_raising_hand",
    "\U0001f645": "person_gesturing_NO",
    "\U0001f646": "person_gesturing_OK",
    "\U0001f3c3": "person_running",
    "\U0001f483": "woman_dancing",
    "\U0001f61b": "face_with_tongue",
    "\U0001f60b": "face_savoring_food",
    "\U0001f625": "sad_but_relieved_face",
    "\U0001f613": "downcast_face_with_sweat",
    "\U0001f630": "anxious_face_with_sweat",
    "\U0001f635": "face_with_crossed-out_eyes",
    "\U0001f920": "cowboy_hat_face",
    "\U0001f47d": "alien",
    "\U0001f916": "robot",
    "\U0001f468\u200d\U0001f469\u200d\U0001f467": "family_man_woman_girl",
    "\U0001f468\u200d\U0001f469\u200d\U0001f466": "family_man_woman_boy",
}

# Territories that have a flag and are not in ISO 3166.
OTHER_TERRITORIES = ("AC", "CP", "DG", "EA", "EU", "IC", "TA", "UN", "XK")

# Sentinel written to x_emoji when a text has no emoji.
NO_EMOJI = "<NO_EMOJI>"

# Characters Python's str.strip() removes (str.isspace()), all in the BMP.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ZWJ = "\u200d"
VS16 = "\ufe0f"
KEYCAP = "\u20e3"
REGIONAL_INDICATOR_FIRST = 0x1F1E6
# --- end of fixed values ----------------------------------------------------


def _parse_ranges(text: str) -> list[tuple[int, int]]:
    out = []
    for tok in text.split():
        lo, _, hi = tok.partition("-")
        out.append((int(lo, 16), int(hi or lo, 16)))
    return out


@lru_cache(maxsize=1)
def emoji_ranges() -> tuple[tuple[int, int], ...]:
    """Sorted, merged inclusive ranges of single emoji code points."""
    rs = sorted(_parse_ranges(EMOJI_RANGES_14) + _parse_ranges(EMOJI_RANGES_15))
    merged: list[list[int]] = []
    for lo, hi in rs:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return tuple((lo, hi) for lo, hi in merged)


def emoji_code_points() -> list[int]:
    return [cp for lo, hi in emoji_ranges() for cp in range(lo, hi + 1)]


def _hex(cp: int) -> str:
    return "\\x{%X}" % cp


def emoji_class_body() -> str:
    """Body of a character class matching one emoji code point (no brackets)."""
    parts = []
    for lo, hi in emoji_ranges():
        parts.append(_hex(lo) if lo == hi else f"{_hex(lo)}-{_hex(hi)}")
    return "".join(parts)


def emoji_class() -> str:
    return f"[{emoji_class_body()}]"


def class_tree(ranges: tuple[tuple[int, int], ...]) -> str:
    """The class of sorted ranges for Java, which tests the parts of a class one after the other: nested
    halves behind their outer bounds, so that some eight comparisons decide instead of all of them."""
    if len(ranges) <= 2:
        return "[" + "".join(f"{_hex(lo)}-{_hex(hi)}" for lo, hi in ranges) + "]"
    mid = len(ranges) // 2
    halves = [f"[{_hex(r[0][0])}-{_hex(r[-1][1])}&&{class_tree(r)}]" for r in (ranges[:mid], ranges[mid:])]
    return f"[{_hex(ranges[0][0])}-{_hex(ranges[-1][1])}&&[{''.join(halves)}]]"


def non_emoji_run() -> str:
    return f"[^{emoji_class_body()}]+"


def seq_pattern() -> str:
    """One emoji sequence, longest form first: flag pair, keycap, or an
    emoji with optional VS16/skin tone, chained by ZWJ."""
    return seq_pattern_with(emoji_class())


def seq_pattern_with(e: str) -> str:
    """``seq_pattern`` with ``e`` as the single-emoji pattern."""
    # a tag sequence (subdivision flags) follows its base and ends with the cancel tag
    mod = "(?:\\x{FE0F}|[\\x{1F3FB}-\\x{1F3FF}])?(?:[\\x{E0020}-\\x{E007E}]+\\x{E007F})?"
    flag = "[\\x{1F1E6}-\\x{1F1FF}]{2}"
    keycap = "[0-9#*]\\x{FE0F}?\\x{20E3}"
    return f"{flag}|{keycap}|{e}{mod}(?:\\x{{200D}}{e}{mod})*"


def seq_starters_class_body() -> str:
    """Code points that can begin a sequence."""
    return emoji_class_body() + "\\x{1F1E6}-\\x{1F1FF}0-9#*"


def high_starter_ranges() -> tuple[tuple[int, int], ...]:
    """Code points above ASCII that can begin a sequence."""
    return tuple(sorted((*emoji_ranges(), (REGIONAL_INDICATOR_FIRST, REGIONAL_INDICATOR_FIRST + 25))))


def piece_pattern() -> str:
    """Split a text into pieces: a whole emoji sequence, a run of characters
    that cannot start one, or any single other character."""
    return f"(?s)({seq_pattern()}|[^{seq_starters_class_body()}]+|.)"


def unicode_short_name(cp: int) -> str | None:
    """The Unicode character name; that of the tables of version 15, so that it does
    not follow the Python that builds the plan beyond the table's own code points."""
    name = unicodedata.name(chr(cp), None)
    if name is None:
        return None
    return name.lower().replace(" ", "_")


@lru_cache(maxsize=1)
def lexicon() -> dict[str, str]:
    """Emoji (single code point or listed sequence) -> short name."""
    out: dict[str, str] = {}
    for cp in emoji_code_points():
        nm = unicode_short_name(cp)
        if nm is not None:
            out[chr(cp)] = nm
    out.update(SHORT_NAME_OVERRIDES)
    return out


def lexicon_rows() -> list[tuple[str, str, int]]:
    """(seq, name, n_codepoints) rows of the emoji_lexicon table."""
    return [(k, v, len(k)) for k, v in sorted(lexicon().items())]


def regional_indicators() -> str:
    return "".join(chr(REGIONAL_INDICATOR_FIRST + i) for i in range(26))


def latin_capitals() -> str:
    return "".join(chr(ord("A") + i) for i in range(26))
