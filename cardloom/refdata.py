"""Tables, word lists and patterns that results depend on."""

# --- fixed values -------------------------------------------------------------------------
GOVERNORATES = {
    "01": "القاهرة", "02": "الإسكندرية", "03": "بورسعيد", "04": "السويس", "11": "دمياط", "12": "الدقهلية", "13": "الشرقية",
    "14": "القليوبية", "15": "كفر الشيخ", "16": "الغربية", "17": "المنوفية", "18": "البحيرة", "19": "الإسماعيلية", "21": "الجيزة",
    "22": "بني سويف", "23": "الفيوم", "24": "المنيا", "25": "أسيوط", "26": "سوهاج", "27": "قنا", "28": "أسوان", "29": "الأقصر",
    "31": "البحر الأحمر", "32": "الوادي الجديد", "33": "مطروح", "34": "شمال سيناء", "35": "جنوب سيناء", "88": "خارج الجمهورية",
}

GOVERNORATES_EN = {
    "01": "Cairo", "02": "Alexandria", "03": "Port Said", "04": "Suez", "11": "Damietta", "12": "Dakahlia", "13": "Sharqia",
    "14": "Qalyubia", "15": "Kafr El Sheikh", "16": "Gharbia", "17": "Monufia", "18": "Beheira", "19": "Ismailia", "21": "Giza",
    "22": "Beni Suef", "23": "Faiyum", "24": "Minya", "25": "Asyut", "26": "Sohag", "27": "Qena", "28": "Aswan", "29": "Luxor",
    "31": "Red Sea", "32": "New Valley", "33": "Matrouh", "34": "North Sinai", "35": "South Sinai", "88": "Outside Egypt",
}

#: Detector class (lower case, without the invalid_ prefix) to field.
FIELD_ALIASES = {
    "address": "address", "firstname": "first_name", "lastname": "last_name", "nid": "nid", "nid_back": "nid_back", "serial": "serial",
    "photo": "photo", "dob": "date_of_birth", "expiry": "expiry", "issue": "issue", "job": "job", "demo": "demographics",
    "poe": "place_of_employment", "front_logo": "logo", "barcode": "barcode", "watermark_tut": "watermark",
}

#: Class index of the secondary detector to field; other classes are dropped.
REGION_CLASSES = {0: "last_name", 1: "address", 3: "first_name", 5: "nid"}

#: Crop margins (width, height) by field.
FIELD_MARGINS = {"first_name": (1.15, 1.30), "last_name": (1.10, 1.25), "address": (1.12, 1.35), "nid": (1.18, 1.60)}
DEFAULT_MARGIN = (1.10, 1.20)
CARD_MARGIN = 1.04

#: Clockwise degrees that turn a card upright.
ORIENTATION_ROTATION = {"up": 0, "right": 90, "down": 180, "left": 270}
SIDES = ("front", "back")
REQUIRED_FIELDS = ("first_name", "last_name", "address", "nid")

#: Spelling variants of one word, wrong to right.
ORTHOGRAPHIC_FIXES = {
    "احمد": "أحمد", "ابراهيم": "إبراهيم", "اسماعيل": "إسماعيل", "اسلام": "إسلام", "ايمن": "أيمن", "امين": "أمين", "انس": "أنس",
    "انور": "أنور", "اشرف": "أشرف", "الهام": "إلهام", "ابو": "أبو", "اسيوط": "أسيوط", "اسامه": "أسامة", "اسامة": "أسامة",
    "امنه": "آمنة", "اميره": "أميرة", "سميه": "سمية", "فاطمه": "فاطمة", "عائشه": "عائشة", "خديجه": "خديجة", "ناديه": "نادية",
    "القاهره": "القاهرة", "الاسكندريه": "الإسكندرية", "الجيزه": "الجيزة", "القليوبيه": "القليوبية", "المنصوره": "المنصورة",
    "الاسماعيليه": "الإسماعيلية", "البحيره": "البحيرة", "الدقهليه": "الدقهلية", "الشرقيه": "الشرقية", "الغربيه": "الغربية",
    "المنوفيه": "المنوفية", "قريه": "قرية", "عزبه": "عزبة", "ناحيه": "ناحية", "مصطفي": "مصطفى", "موسي": "موسى", "يحيي": "يحيى",
    "سلوي": "سلوى", "ليلي": "ليلى", "عبدالله": "عبد الله", "عبدالرحمن": "عبد الرحمن", "عبدالعزيز": "عبد العزيز",
    "كفرالشيخ": "كفر الشيخ", "بنيسويف": "بني سويف",
}

#: Words that rightly end in a bare heh.
TA_MARBUTA_EXCEPTIONS = ("الله", "لله", "عبده", "الاله", "الإله", "فيه", "منه", "له")

COMMON_NAMES = (
    "أحمد", "محمد", "محمود", "مصطفى", "إبراهيم", "علي", "حسين", "حسن", "خالد", "عمر", "عبد الرحمن", "عبد الله", "عبد العزيز", "طارق",
    "عمرو", "يوسف", "ياسين", "زياد", "كريم", "حازم", "هشام", "وائل", "رامي", "تامر", "سعيد", "صالح", "عادل", "عصام", "ماجد", "وليد",
    "أشرف", "أيمن", "إسلام", "بهاء", "جمال", "رجب", "سعد", "شعبان", "صلاح", "طاهر", "عاطف", "عوض", "فاروق", "فؤاد", "كمال", "ممدوح",
    "نبيل", "هاني", "ياسر", "أميرة", "إيمان", "دعاء", "ريهام", "سارة", "شيماء", "فاطمة", "مروة", "منى", "نادية", "نجلاء", "هبة",
    "ياسمين", "زينب", "خديجة", "عائشة", "سمية", "ليلى", "سلوى", "نورهان", "إسراء", "آية",
)

ADDRESS_TERMS = (
    *GOVERNORATES.values(), "مركز", "قسم", "شياخة", "قرية", "عزبة", "شارع", "حي", "مدينة", "ميدان", "منطقة", "شبرا", "المعادي", "حلوان",
    "الدقي", "العجوزة", "المهندسين", "إمبابة", "الهرم", "فيصل", "الزقازيق", "المنصورة", "طنطا", "المحلة", "بنها", "دمنهور", "دسوق",
    "شبين الكوم", "أشمون", "قويسنا", "ميت غمر", "بلبيس", "فاقوس", "العياط", "مغاغة", "سمالوط", "ملوي", "منفلوط", "طهطا", "أخميم",
    "جرجا", "نجع حمادي", "إدفو", "كوم أمبو",
)

LEXICONS = {"name": COMMON_NAMES, "address": ADDRESS_TERMS}
AMBIGUITY_MARGIN = 4
MIN_CORRECTED = 4

#: Digits of the two Arabic ranges, in order.
ARABIC_INDIC, EXTENDED_ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
ARABIC_CHARS = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
DIACRITICS = "ً-ٰٟۖ-ۭ"
TATWEEL = "ـ"
OCR_NOISE = r"|\[\]{}<>_=+*^~\\/©®°¦¬"

ID_LENGTH = 14
ID_WEIGHTS = (2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CENTURIES = {"2": 1900, "3": 2000}
# --- end of fixed values ------------------------------------------------------------------
