"""CSS colours as columns: four channels from 0 to 1."""

from __future__ import annotations

import colorsys
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named colours of CSS, as hexadecimal RGB.
NAMED = dict(
    x.split(":")
    for x in """
aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000
blanchedalmond:ffebcd blue:0000ff blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00
chocolate:d2691e coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c cyan:00ffff darkblue:00008b
darkcyan:008b8b darkgoldenrod:b8860b darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9 darkkhaki:bdb76b
darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00 darkorchid:9932cc darkred:8b0000 darksalmon:e9967a
darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f darkslategrey:2f4f4f darkturquoise:00ced1
darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969 dimgrey:696969 dodgerblue:1e90ff firebrick:b22222
floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520
gray:808080 green:008000 greenyellow:adff2f grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082
ivory:fffff0 khaki:f0e68c lavender:e6e6fa lavenderblush:fff0f5 lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6
lightcoral:f08080 lightcyan:e0ffff lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightgrey:d3d3d3
lightpink:ffb6c1 lightsalmon:ffa07a lightseagreen:20b2aa lightskyblue:87cefa lightslategray:778899 lightslategrey:778899
lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00 limegreen:32cd32 linen:faf0e6 magenta:ff00ff maroon:800000
mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3 mediumpurple:9370db mediumseagreen:3cb371
mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585 midnightblue:191970
mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5 navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000
olivedrab:6b8e23 orange:ffa500 orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa palegreen:98fb98 paleturquoise:afeeee
palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd powderblue:b0e0e6
purple:800080 rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072
sandybrown:f4a460 seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0 skyblue:87ceeb slateblue:6a5acd
slategray:708090 slategrey:708090 snow:fffafa springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080 thistle:d8bfd8
tomato:ff6347 transparent:00000000 turquoise:40e0d0 violet:ee82ee wheat:f5deb3 white:ffffff whitesmoke:f5f5f5
yellow:ffff00 yellowgreen:9acd32
""".split()
)

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"
_CALL = re.compile(r"(rgb|hsl)a?\((.*)\)")


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


def _share(text: str, whole: float) -> float:
    """A channel: a percentage, or a number of which `whole` is all."""
    number = float(re.match(_NUMBER, text)[0])
    return _unit(number / 100 if text.endswith("%") else number / whole)


def parse_color(css: str) -> tuple[float, float, float, float] | None:
    """The channels of a CSS colour: a name, 3, 4, 6 or 8 hexadecimal digits, rgb() or hsl(), with commas or spaces."""
    text = css.strip().lower()
    text = f"#{NAMED[text]}" if text in NAMED else text
    if re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", text):
        digits = text[1:] if len(text) > 5 else "".join(x * 2 for x in text[1:])
        channels = [int(digits[k : k + 2], 16) / 255 for k in range(0, len(digits), 2)]
        return (*channels, 1.0)[:4]
    call = _CALL.fullmatch(text)
    parts = [x for x in re.split(r"\s*,\s*" if "," in call[2] else r"[\s/]+", call[2].strip()) if x] if call else []
    if len(parts) not in (3, 4) or not all(re.match(_NUMBER, x) for x in parts):
        return None
    alpha = _share(parts[3], 1) if len(parts) == 4 else 1.0
    if call[1] == "rgb":
        return (*(_share(x, 255) for x in parts[:3]), alpha)
    if not (parts[1].endswith("%") and parts[2].endswith("%")):
        return None
    hue = float(re.match(_NUMBER, parts[0])[0]) % 360 / 360
    return (*colorsys.hls_to_rgb(hue, _share(parts[2], 1), _share(parts[1], 1)), alpha)


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), whose value is computed once however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def color_channels(css: Column) -> Column:
    """array(r, g, b, a) of a column of CSS colours: names, hexadecimal digits and rgb(); null where there is none."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def of_digits(text: Column) -> Column:
        digits = F.coalesce(F.try_element_at(names, text), F.regexp_extract(text, r"^#([0-9a-f]{3,8})$", 1))
        digits = _bound(digits, lambda d: F.when(F.length(d).isin(3, 4), F.regexp_replace(d, "(.)", "$1$1")).otherwise(d))
        return _bound(digits, lambda d: F.when(F.length(d) == 6, F.concat(d, F.lit("ff"))).otherwise(d))

    def of_parts(parts: Column) -> Column:
        number = lambda x: F.regexp_extract(x, f"^({_NUMBER})", 1).try_cast("double")
        part = lambda k, whole: _bound(F.get(parts, F.lit(k)), lambda x: _clamp(number(x) / F.when(x.endswith("%"), 100.0).otherwise(whole)))
        channels = F.array(part(0, 255.0), part(1, 255.0), part(2, 255.0), F.when(F.size(parts) == 4, part(3, 1.0)).otherwise(1.0))
        return F.when(F.size(parts).isin(3, 4), _bound(channels, lambda c: F.when(~F.exists(c, lambda x: x.isNull()), c)))

    from_hex = lambda digits: F.array(*[F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5, 7)])
    from_call = lambda text: _bound(F.filter(F.split(F.regexp_extract(text, r"^rgba?\((.*)\)$", 1), r"[\s,/]+"), lambda x: x != ""), of_parts)
    either = lambda text: _bound(of_digits(text), lambda digits: F.when(F.length(digits) == 8, from_hex(digits)).otherwise(from_call(text)))
    return _bound(F.lower(F.trim(css)), either)


def lerp_channels(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def format_color(channels: Column, number_text: Callable[[Column], Column]) -> Column:
    """rgba(r,g,b,a) with the first three from 0 to 255 and alpha to four places."""

    def text(c: Column) -> Column:
        byte = lambda k: F.floor(F.get(c, F.lit(k)) * 255 + 0.5).cast("int").cast("string")
        alpha = _bound(F.floor(F.get(c, F.lit(3)) * 10000 + 0.5) / 10000, number_text)
        return F.concat(F.lit("rgba("), byte(0), F.lit(","), byte(1), F.lit(","), byte(2), F.lit(","), alpha, F.lit(")"))

    return _bound(channels, text)
