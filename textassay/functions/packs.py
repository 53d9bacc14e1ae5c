"""Rule packs: vocabularies are data, semantics live in operators.rules."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class CustomRule:
    name: str
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    dimension: str = "scam"
    contribution: float = 20.0
    confidence: float = 0.7
    platform: str | None = None
    min_hits: int = 1


@dataclasses.dataclass(frozen=True)
class Pack:
    scam: tuple[str, ...]
    anxiety: tuple[str, ...]  # regular expressions
    promo: tuple[str, ...]
    hedging: tuple[str, ...]  # literal text, counted by occurrence
    credibility: tuple[tuple[str, ...], ...]
    combos: tuple[tuple[str, tuple[str, ...], str, float], ...]  # name, keywords, dimension, boost
    platforms: tuple[tuple[str, tuple[str, ...]], ...]
    citing: tuple[str, ...]
    custom: tuple[CustomRule, ...] = ()


#: English wording of each concern.
LATIN = Pack(
    scam=(
        "guaranteed returns",
        "guaranteed profit",
        "risk-free profit",
        "double your money",
        "get rich quick",
        "wire transfer",
        "upfront fee",
        "claim your prize",
        "you have been selected",
        "send your bank details",
        "verify your account now",
        "no experience needed",
        "earn from home",
        "secret system",
        "act now",
    ),
    anxiety=(
        "(?i)last chance",
        "(?i)before it(’|')?s too late",
        "(?i)you(’|')?(ll| will) regret",
        "(?i)(everyone|everybody) (else )?is already",
        "(?i)don(’|')?t be left behind",
        "(?i)if you (still )?don(’|')?t .{1,40} now",
        "(?i)most people (will )?never",
    ),
    promo=(
        "sponsored",
        "buy now",
        "order today",
        "limited time offer",
        "use code",
        "free shipping",
        "click the link",
        "sign up today",
        "discount code",
        "affiliate link",
        "add to cart",
        "special price",
    ),
    hedging=(
        "it is worth noting",
        "it is important to note",
        "in conclusion",
        "in today's fast-paced world",
        "plays a crucial role",
        "in summary",
        "a wide range of",
        "delve into",
        "on the one hand",
        "needless to say",
    ),
    credibility=(
        ("sources say", "studies show", "experts agree", "scientists have proven"),
        ("they don't want you to know", "the truth they hide", "what nobody tells you", "mainstream media won't"),
        ("100% effective", "works instantly", "miracle cure", "proven to cure"),
    ),
    combos=(
        ("combo_urgent_offer", ("limited time offer", "buy now"), "adv", 15.0),
        ("combo_fee_first", ("upfront fee", "wire transfer"), "scam", 20.0),
    ),
    platforms=(
        ("forum", ("upvote", "original poster", "this thread", "mods please")),
        ("shop", ("add to cart", "free shipping", "five-star review", "link in bio")),
    ),
    citing=("fact check", "beware of", "how to spot", "consumer warning", "debunked"),
    custom=(
        CustomRule("custom_abuse", ("trash", "worthless", "scum", "disgusting", "clown", "idiot"), (), "emo", 25.0, 0.75, None, 2),
        CustomRule("custom_symbols", ("###", "$$$", "&&&"), ("[*]{3}",), "adv", 25.0, 0.75, None, 2),
        CustomRule("custom_shout", (), ("[A-Z]{4,} [A-Z]{4,}[ !]",), "emo", 30.0, 0.8),
    ),
)

#: Chinese wording.
ZH = Pack(
    scam=("稳赚不赔", "日入过万", "内部名额", "先交押金", "轻松月入", "保本高收益", "刷单返利", "转账到指定账户"),
    anxiety=("再不.*就晚了", "后悔一辈子", "最后.*机会", "别人都已经", "错过.*再等"),
    promo=("限时优惠", "扫码领取", "点击下单", "立即购买", "优惠券", "包邮", "下单立减"),
    hedging=("众所周知", "值得注意的是", "总而言之", "综上所述", "不可否认", "与此同时"),
    credibility=(("专家称", "据知情人士"), ("他们不想让你知道",), ("百分百有效", "立竿见影")),
    combos=(("combo_promo", ("限时优惠", "扫码领取"), "adv", 15.0),),
    platforms=(("shop", ("种草", "拔草", "好物")),),
    citing=("反诈提示", "辟谣"),
)

DIMENSIONS = ("scam", "emo", "adv", "ai")
POSITIVE = (("originality", 1.0), ("info_density", 1.0), ("reasoning_quality", 1.0), ("readability", 0.8), ("timeliness", 0.6))
NEGATIVE = (("ai", 0.8), ("emo", 1.0), ("adv", 1.0), ("scam", 1.2))
#: label, dimension, least score
LABELS = (("ai_generated", "ai", 70), ("emotional", "emo", 65), ("advertorial", "adv", 70), ("scam", "scam", 60), ("original", "originality", 80), ("dense", "info_density", 80))
