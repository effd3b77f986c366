"""Fixed values of the domain, and settings with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Fixed values.
#: Cruise speed by weapon type, km/h.
SPEED_KMH = {"shahed": 180, "bpla": 150, "s300": 2000, "kab": 900, "iskander": 2100, "missile": 900, "fpv": 120, "molniya": 220, "lancet": 300, "ballistic": 2500, "rszo": 700, "unknown": 200}
LABELS = {"shahed": "Шахед-136", "bpla": "Ударний БпЛА", "s300": "С-300", "kab": "КАБ", "iskander": "Іскандер", "missile": "Ракета", "fpv": "FPV-дрон", "molniya": "Молнія", "lancet": "Ланцет", "ballistic": "Балістика", "rszo": "РСЗВ", "unknown": "Невідомо"}
COLORS = {"shahed": "#aa66ff", "bpla": "#ff8800", "s300": "#ff4444", "kab": "#ff8800", "iskander": "#ff2266", "missile": "#ff4444", "fpv": "#ffb020", "molniya": "#ffa000", "lancet": "#cc5500", "ballistic": "#ff0033", "rszo": "#ff6644", "unknown": "#888888"}
#: What is said of a target beside it, by weapon, and of one of another kind.
THREAT_NOTES = {
    "shahed": "Повільна, але тривала загроза; можливі маневри над містом.", "bpla": "Ймовірний дорозвід/удар, маршрут може швидко змінюватись.", "fpv": "Низька висота і коротке плече, критично важлива швидка реакція.",
    "molniya": "Швидший БпЛА з ризиком раптової зміни напряму.", "lancet": "Баражуючий боєприпас, небезпечний для відкритої місцевості.", "ballistic": "Балістична загроза з мінімальним підльотним часом.",
    "rszo": "Залпові ураження, можливі серії з короткими інтервалами.", "missile": "Ракетна загроза, слідкуйте за оновленнями напрямку польоту.", "iskander": "Висока швидкість ураження, рекомендоване негайне укриття.",
    "s300": "Високошвидкісна загроза, не ігноруйте навіть короткі попередження.", "kab": "Керована авіабомба, ризик ураження поблизу лінії заходу.",
}
OTHER_NOTE = "Тип цілі уточнюється, дотримуйтесь базових правил укриття."
STATUS_LABELS = {"impact": "Влучання", "expired": "Завершено", "active": "Активна"}
#: Weapons that are tracked as incidents; others mark districts.
TRACKED = ("bpla", "shahed", "molniya", "fpv", "lancet", "unknown")
DRONES = ("bpla", "shahed")
#: Distance of an inferred origin, km.
INGRESS_KM = {"kab": 28, "missile": 45, "ballistic": 70, "iskander": 70, "s300": 55, "rszo": 25}
#: Messages with any of these are never published.
SAFETY_KEYWORDS = ("ППО", "ПВО", "ЗРК", "ПЗРК", "зенітний", "зенітна", "зенитный", "зенитная", "перехоплення", "перехватил", "перехвачен", "збили", "збито", "сбили", "сбит", "работает ПВО", "працює ППО", "позиція ППО", "позиция ПВО")
WEAPON_ALIASES = {
    "shahed": ("Р шаболда", "Реактивная шаболда", "Шаболда", "шаболдам", "шаболдах", "Шаболды", "Шахед", "Шахедів", "шахедов", "shahed"),
    "bpla": ("БПЛА", "БПЛА неизвестно типа", "БПЛА неизвестного", "БПЛА неизвестного типа", "БПЛП неизвестного типа", "Группа БПЛА", "ударный", "Ударный БПЛА", "bpla"),
    "s300": ("s300",),
    "kab": ("КАБ", "КАБів", "kab"),
    "missile": ("КР", "Крылатая ракета", "крылатой ракеты", "крылатые ракеты", "missile"),
    "fpv": ("fpv",),
    "molniya": ("Молнией", "Молнию", "Молния", "Молния/", "molniya"),
    "lancet": ("БПЛА Ланцет", "Ланцет", "угроза БПЛА Ланцет", "lancet"),
    "ballistic": ("баллистика", "баллистическая", "по баллистике", "тревога по баллистике", "угроза баллистики", "ballistic"),
    "rszo": ("запуски РСЗО", "РСЗО", "РСЗО на", "rszo"),
}
#: Tried in order where no alias is found; \b counts ASCII word characters only.
WEAPON_PATTERNS = (
    ("iskander", "[Іи]скандер"), ("s300", "с-?300"), ("kab", "каб"), ("missile", "крылат(?:ая|ые)?\\s+ракет|ракет[аыі]"), ("ballistic", "баллист"),
    ("rszo", "рсзо"), ("lancet", "ланцет"), ("fpv", "fpv"), ("molniya", "молни"), ("bpla", "БпЛА|дрон|ударн"),
)
PHRASE_INTENTS = (
    ("heading_change", "(?:довернул[а]?|развернул(?:ся|ась|ись)|взял[а]?\\s+курс|повернул[а]?|разогнулся)\\s+на\\s+(.+)"),
    ("current_location", "(?:над|кружит(?:\\s+(?:в\\s+районе|над|западнее|севернее|южнее|восточнее))?|локационно)\\s+(.+)"),
    ("via_location", "(?:далее(?:\\s+(?:курс\\s+)?на?)?|через|вдоль\\s+окружной\\s+на|летит\\s+(?:курсом|ближе\\s+к))\\s+(.+)"),
    ("continuation", "(?:снова(?:\\s+взял[а]?\\s+курс\\s+на)?|опять\\s+на|повторные\\s+пуски(?:\\s+КАБ)?\\s+на|заходят\\s+на\\s+повторные)\\s*(.*)"),
    ("additional_unit", "(?:ещ[её]\\s+(?:\\d+[-\\d]*\\s+)?(?:шаболда[ы]?|БПЛА|молния|ударный)?|следом\\s+ещ[её]\\s+\\d+|новая\\s+шаболда)\\s*(?:на|курс[ом]?)?\\s*(.*)"),
    ("correction", "(?:[Uu]pd[.:]\\s*|это\\s+|отбой,?\\s+это\\s+|предварительно\\s+)(.+)"),
    ("impact", "(?:упал[иа]?|предварительно\\s+(?:упал[иа]?|сбили)|сбили|приземлили|задавили)(?:\\s+в\\s+(?:области|районе))?"),
    ("clear_status", "(?:не\\s+наблюдается|больше\\s+не\\s+(?:наблюдается|фиксируется)|локационно\\s+не\\s+фиксируется|отбой(?:\\s+для\\s+\\S+)?|(?:на\\s+сейчас\\s+)?чисто|без\\s+угрозы(?:\\s+для\\s+\\S+)?|вылетел[оа]\\s+(?:из\\s+города|в\\s+\\S+))"),
    ("acoustic_observation", "акустически\\s+(.+)"),
    ("situational_summary", "(?:локационно|по\\s+шаболдам|по\\s+области|на\\s+сейчас\\s+локационно)[\\s\\n]+(.+)"),
    ("launch_alert", "(?:петухи\\s+заходят\\s+на\\s+пуски\\s+по|заходят\\s+на\\s+пуски\\s+по|активность\\s+пусковых|запуски\\s+РСЗО\\s+по|угроза\\s+РСЗО\\s+для|тревога\\s+по\\s+баллистике\\s+с)\\s+(.+)"),
)
#: Intents that bear on correlation.
HINTS = ("heading_change", "continuation", "additional_unit", "correction")
#: Districts by the names that places and maps have for them.
DISTRICT_NAMES = {
    "Салтівський район": "saltivskyi", "Київський район": "kyivskyi", "Шевченківський район": "shevchenkivskyi", "Холодногірський район": "kholodnohirskyi", "Новобаварський район": "novobavarskyi",
    "Основ'янський район": "osnovianskyi", "Слобідський район": "slobidskyi", "Немишлянський район": "nemyshlianskyi", "Індустріальний район": "industrialnyi",
    "Салтівський": "saltivskyi", "Київський": "kyivskyi", "Шевченківський": "shevchenkivskyi", "Холодногірський": "kholodnohirskyi", "Новобаварський": "novobavarskyi",
    "Основ'янський": "osnovianskyi", "Слобідський": "slobidskyi", "Немишлянський": "nemyshlianskyi", "Індустріальний": "industrialnyi",
}
AMBIGUITY_WEIGHTS = {"HIGH": 0.22, "MEDIUM": 0.12, "LOW": 0.06}
# End of the fixed values.


@dataclass(frozen=True)
class Settings:
    """Thresholds and windows; times in seconds, distances in km."""

    center: tuple[float, float] = (49.9935, 36.2304)
    city: str = "Харків"
    region: str = "Харківська область"
    community: str = "громада"
    nearby_km: float = 90.0
    link_confidence: float = 0.6
    fallback_link: float = 0.35
    approach_anchor: tuple[float, float] = (50.42, 36.75)
    attach_geo: float = 0.5
    attach_no_geo: float = 0.35
    channel_window: int = 180
    active_window: int = 1200
    stale_after: int = 1800
    same_point_km: float = 0.15
    fallback_heading_km: float = 14.0
    ahead_km: float = 12.0
    red_minutes: float = 2.0
    orange_minutes: float = 3.0
    edge_km: float = 5.0
    orange_eta: int = 180
    cooldown_ms: int = 300_000
    override_ms: int = 600_000
    context_rows: int = 6
    context_window: int = 1200
    recent_hours: int = 24
    alias_confidence: float = 0.7
    low_confidence: float = 0.65
    #: Ask all-clear messages to close incidents instead of refreshing them.
    strict_all_clear: bool = False
    #: Seconds after which impacts expire as well; 0: never.
    impact_ttl: int = 0
    keywords: tuple[str, ...] = field(default=SAFETY_KEYWORDS)

    @classmethod
    def from_env(cls, prefix: str = "TOCSIN_") -> Settings:
        """Defaults overridden by variables such as TOCSIN_STALE_AFTER."""
        out = {}
        for name, f in cls.__dataclass_fields__.items():
            if (raw := os.environ.get(prefix + name.upper())) is not None and isinstance(f.default, (int, float, str)):
                out[name] = raw.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**out)
