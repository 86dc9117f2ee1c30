"""Theme colours: the scheme of a theme part, tints, and colours as ARGB.

A colour is an ARGB text or a dictionary: ``{"rgb": ...}``, ``{"theme": n, "tint": t}``, ``{"indexed": n}`` or ``{"auto": True}``.
Tints change the luminance in whole steps of 1/240, with every quotient rounded half up, as the system routines that
spreadsheets use do; so shades are equal to the last bit.
"""

from __future__ import annotations

import math
import re

from .package import Element

#: Colours of a scheme in the order of their theme numbers.
SLOTS = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
#: System colours that name no value of their own.
SYSTEM_COLORS = {"window": "FFFFFF", "windowText": "000000"}
FULL = 240


def theme_colors(root: Element) -> list[str] | None:
    """RRGGBB by theme number; None unless all twelve are known."""
    scheme = next(iter(root.all("clrScheme")), None)
    if scheme is None:
        return None
    out = []
    for slot in SLOTS:
        entry = scheme.first(slot)
        out.append(next((c for c in map(_scheme_color, entry.children if entry else []) if c), None))
    return out if all(out) else None


def _scheme_color(e: Element) -> str | None:
    if e.name == "srgbClr":
        given = e.get("val", "")
    elif e.name == "sysClr":
        given = e.get("lastClr", "")
        if not re.fullmatch("[0-9A-Fa-f]{6}", given):
            given = SYSTEM_COLORS.get(e.get("val", ""), "")
    else:
        return None
    return given.upper() if re.fullmatch("[0-9A-Fa-f]{6}", given) else None


def _rounded(a: int, b: int) -> int:
    return (a + b // 2) // b


def to_hls(rgb: tuple[int, int, int]) -> tuple[int, int, int]:
    """Hue, luminance and saturation in steps of 1 / FULL; greys have hue 160."""
    high, low = max(rgb), min(rgb)
    spread, both = high - low, high + low
    light = _rounded(both * FULL, 510)
    if not spread:
        return 160, light, 0
    saturation = _rounded(spread * FULL, both if light <= FULL // 2 else 510 - both)
    # how far each channel is below the highest, in sixths of the circle
    red, green, blue = (_rounded((high - c) * (FULL // 6), spread) for c in rgb)
    hue = (blue - green, FULL // 3 + red - blue, 2 * FULL // 3 + green - red)[rgb.index(high)]
    return hue + FULL if hue < 0 else hue, light, saturation


def from_hls(hue: int, light: int, saturation: int) -> tuple[int, int, int]:
    if not saturation:
        grey = _rounded(light * 255, FULL)
        return grey, grey, grey
    top = _rounded(light * (FULL + saturation), FULL) if light <= FULL // 2 else light + saturation - _rounded(light * saturation, FULL)
    bottom, sixth = 2 * light - top, FULL // 6

    def channel(turn: int) -> int:
        # a full turn is itself, not 0
        at = turn if 0 <= turn <= FULL else turn % FULL
        rise = at if at < sixth else sixth if at < 3 * sixth else 4 * sixth - at if at < 4 * sixth else 0
        level = top if rise == sixth else bottom + _rounded((top - bottom) * rise, sixth)
        return _rounded(level * 255, FULL)

    return channel(hue + FULL // 3), channel(hue), channel(hue - FULL // 3)


def tinted(rgb: str, tint: float) -> str:
    """RRGGBB made lighter (tint up to 1) or darker (down to -1)."""
    t = min(1.0, max(-1.0, tint)) if math.isfinite(tint) else 0.0
    if t == 0:
        return rgb.upper()
    hue, light, saturation = to_hls(tuple(bytes.fromhex(rgb)))
    wanted = light * (1 + t) if t < 0 else light * (1 - t) + FULL - FULL * (1 - t)
    return bytes(from_hls(hue, math.floor(wanted + 0.5), saturation)).hex().upper()


def resolve_color(color: str | dict | None, theme: list[str] | None) -> str | None:
    """AARRGGBB, or None for automatic and indexed colours and those of a theme that isn't known."""
    if isinstance(color, str):
        color = {"rgb": color}
    if not color:
        return None
    if "rgb" in color:
        rgb = color["rgb"].upper()
        return "FF" + rgb if len(rgb) == 6 else rgb
    n = color.get("theme")
    if n is None or theme is None or not 0 <= n < len(theme):
        return None
    return "FF" + tinted(theme[n], color.get("tint", 0.0))
