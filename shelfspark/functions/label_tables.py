"""Word lists of the release-name parser: fixed values that its readings stand on."""

# The spellings of version labels by kind, cuts and reworks, in their own order.
CUT_LABELS = {
    "original": ["original", "original mix", "original version", "original edit", "orig", "orig mix", "og", "og mix", "og version"],
    "extended": ["extended", "extended mix", "extended version", "extended edit", "extended cut", "ext", "ext mix", "ext version", "extd", "xtd"],
    "radio_edit": ["radio edit", "radio mix", "radio version", "radio cut", "radio"],
    "club_edit": ["club edit", "club mix", "club version", "club cut", "club"],
    "short": ["short", "short edit", "short mix", "short version", "short cut"],
    "clean": ["clean", "clean edit", "clean mix", "clean version", "clean cut", "cln"],
    "dirty": ["dirty", "dirty edit", "dirty mix", "dirty version", "dirty cut", "explicit", "explicit version", "drt"],
    "intro": ["intro", "intro edit", "intro mix", "intro version", "dj intro", "with intro"],
    "outro": ["outro", "outro edit", "outro mix", "outro version", "dj outro", "with outro"],
    "intro_outro": ["intro-outro", "intro outro", "intro-outro edit", "intro outro edit", "in-out", "in out", "dj intro outro"],
    "quick_hit": ["quick hit", "quickhit", "quick hitter", "qh"],
    "edit": ["edit"],
    "remaster": ["remaster", "remastered", "remastered version", "remaster version"],
}
REWORK_LABELS = {
    "remix": ["remix", "rmx", "remixed", "re-mix", "remix edit"],
    "vip": ["vip", "vip mix", "vip edit", "vip version"],
    "flip": ["flip", "flipped"],
    "bootleg": ["bootleg", "bootleg mix", "bootleg edit", "boot", "booty", "re-edit"],
    "rework": ["rework", "reworked", "refix", "re-fix", "reboot", "re-boot"],
    "dub": ["dub", "dub mix", "dub version", "dub edit"],
    "cover": ["cover", "cover version", "covered"],
    "live": ["live", "live version", "live mix", "live edit", "live recording"],
    "alternate": [
        "alternate", "alternate mix", "alternate version", "alternate take", "alternate arrangement", "alternative", "alternative mix", "alternative version",
        "alt", "alt mix", "alt version", "alt take",
    ],
    "instrumental": ["instrumental", "instrumental mix", "instrumental version", "inst", "instr"],
    "acapella": ["acapella", "acappella", "accapella", "a cappella", "acapella version", "acap"],
    "mashup": ["mashup", "mash-up", "mash up"],
}
# Words that are no one's name, words before a number that is a title's own, and what joins a label and a name.
NON_NAME_WORDS = [
    "main", "album", "single", "vocal", "video", "full", "long", "hype", "dj", "promo", "special", "new", "final", "bonus", "dance", "party", "acoustic",
    "7", "10", "12", "inch", "lp", "ep", "vinyl", "digital", "tv", "street", "super", "mega", "mini", "maxi", "demo", "rough", "pool", "version", "mix", "the",
]
NUMBER_WORDS = ["part", "pt", "vol", "volume", "no", "nr", "number", "disc", "cd", "side", "track", "take", "chapter", "ch", "episode", "act", "book", "version", "ver", "v", "mix", "cut", "#"]
BY_WORDS, LIVE_PLACE_WORDS, NAMED_MIX_WORDS = ["by"], ["at", "from", "in", "@"], ["mix"]
# What a bracket or the end of a name may hold that says nothing of the recording.
SITE_FILLER_WORDS = ["downloaded", "download", "from", "via", "by", "at", "on", "ripped", "courtesy", "of", "visit", "free", "more", "music"]
RIP_TAGS = [
    "free download", "free dl", "official audio", "official video", "official music video", "hq", "hd", "cdq", "web", "webrip", "web rip", "vinyl rip", "cd rip", "rip",
    "promo", "retag", "retagged", "out now", "premiere",
]
BITRATES = [64, 96, 112, 128, 160, 192, 224, 256, 320]
BITRATE_UNITS = ["kbps", "kbit", "kb", "k"]
FORMAT_WORDS = ["mp3", "flac", "wav", "aiff", "aif", "m4a", "lossless"]
AUDIO_EXTENSIONS = ["mp3", "flac", "wav", "aiff", "aif", "aifc", "m4a", "mp4", "aac", "ogg", "opus", "wma", "alac", "wv", "ape"]
