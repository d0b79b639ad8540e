"""Fixed values that results depend on, stated plainly. All are parameters of the operators that use them."""

# Vietnamese letters with accents and their plain letters, position by position.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyydAAAAAAAAAAAAAAAAAEEEEEEEEEEEIIIIIOOOOOOOOOOOOOOOOOUUUUUUUUUUUYYYYYD"

# Units that a number is set apart from, in the order they are tried.
UNITS = ("mg/ml", "mcg/ml", "mg/actuat", "mg", "mcg", "ml", "iu", "unit", "%")

# Salts that a relaxed drug key leaves out.
SALTS = (
    "maleate", "hydrochloride", "hcl", "sodium", "sulfate", "sulphate", "phosphate", "succinate", "tartrate",
    "besylate", "mesylate", "citrate", "acetate", "fumarate", "bitartrate", "potassium", "calcium",
    "hydrobromide", "nitrate", "dihydrate", "monohydrate",
)

# Concept types, coarse types, assertion labels.
SYMPTOM, TEST_NAME, TEST_VALUE, DIAGNOSIS, DRUG = "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"
TYPES = (SYMPTOM, TEST_NAME, TEST_VALUE, DIAGNOSIS, DRUG)
COARSE = ("PROBLEM", "TEST", "TREATMENT", "OTHER")
ASSERTIONS = ("isNegated", "isFamily", "isHistorical")
CODED_TYPES = (DIAGNOSIS, DRUG)
ASSERTED_TYPES = (DIAGNOSIS, DRUG, SYMPTOM)

# Drug term types that are kept, in the order of preference for a code's name.
TTY_RANK = (
    "SCD", "SBD", "SCDC", "SBDC", "GPCK", "BPCK", "SCDF", "SBDF", "SCDG", "SBDG",
    "MIN", "IN", "PIN", "BN", "PSN", "TMSY", "SY", "SCDGP", "SBDFP", "SCDFP",
)

# Names that are no drugs in running text.
NOT_DRUGS = ("water", "air", "oxygen", "alcohol", "starch", "glucose", "honey", "menthol", "camphor", "caffeine")

# Headings of notes as keys, which are no concepts.
HEADINGS = (
    "tien su benh", "tien su benh noi khoa", "tien su benh ly", "tien su benh hien tai", "tien su phau thuat thu thuat", "tien su phau thuat", "benh su", "benh su hien tai",
    "cac benh ly man tinh", "cac benh ly nen", "cac yeu to nguy co lien quan", "yeu to nguy co", "thuoc truoc khi nhap vien", "thuoc truoc khi nhap vien lan nay", "trieu chung hien tai",
    "cac trieu chung hien tai", "dac diem trieu chung", "ly do nhap vien", "ly do vao vien", "thoi diem khoi phat trieu chung", "danh gia tai benh vien", "ket qua kham lam sang",
    "ket qua xet nghiem", "ket qua chan doan hinh anh", "ket qua hinh anh", "cac su kien truoc khi nhap vien", "cac dien bien truoc khi nhap vien", "cac ket qua chan doan khac",
    "cac phat hien chan doan khac", "thu thuat thuc hien", "cac thu thuat da thuc hien", "tinh trang truoc nhap vien", "trieu chung khi nhap vien", "dien bien benh", "kham lam sang",
    "can lam sang", "vi tri", "muc do nghiem trong", "thoi gian", "tan suat", "chieu xa", "cac yeu to lam nang them", "cac yeu to lam giam", "cac trieu chung lien quan",
    "dau hieu sinh ton", "chua phat hien benh ly bat thuong", "cac tap kinh lam sang truoc day", "dien bien", "tinh trang", "dieu tri", "chan doan",
)

# Negation cues in the order they are tried, and words after a cue that undo it.
NEGATION_CUES = (
    "khong", "chua", "khong co", "khong ghi nhan", "khong phat hien", "khong thay", "khong con", "loai tru",
    "am tinh", "phu nhan", "khong bi", "khong dau", "khong kem", "khong xuat hien",
)
PSEUDO_NEXT = ("xac", "dac", "ro", "do", "dang", "doi", "the", "lien", "on", "on dinh", "can", "kiem", "tu chu", "duoc")
NEGATION_WINDOW, NEGATION_REACH = 120, 45

# Words for relatives (patterns, bounded on the left) and the window before a span.
FAMILY_WORDS = (
    "gia dinh", "tien su gia dinh", "di truyen", "ho hang", "bo(?: benh nhan| ruot|,| )", "me(?: benh nhan| ruot|,| )",
    "cha(?: benh nhan| ruot|,| )", "anh (?:trai|ruot)", "chi (?:gai|ruot)", "em (?:trai|gai|ruot)", "ong (?:noi|ngoai)",
    "ba (?:noi|ngoai)", "con (?:trai|gai) benh nhan", "nguoi than trong gia dinh",
)
FAMILY_WINDOW = 70

# Cues of the past, and titles of sections about it.
PAST_CUES = (
    "tien su", "tien can", "truoc day", "da tung", "cach day", "cach ", "man tinh", "mang tinh", "truoc do", " cu",
    "benh ly nen", "benh nen", "da phau thuat", "da dieu tri", "tu nho", "nhieu nam",
)
PAST_TITLES = (
    "tien su benh noi khoa", "tien su benh ly", "tien su benh", "tien su phau thuat", "cac benh ly man tinh",
    "cac benh ly nen", "benh su", "tien su san khoa",
)
PRESENT_TITLES = ("hien tai", "benh su hien tai", "tien su benh hien tai")
PAST_WINDOW, PAST_AFTER = 140, 8

# Labels of public corpora and what they stand for: source, label, fine, coarse.
LABELS = (
    *(("phoner", x, None, "OTHER") for x in ("PATIENT_ID", "PERSON_NAME", "AGE", "GENDER", "OCCUPATION", "LOCATION", "ORGANIZATION", "TRANSPORTATION", "DATE")),
    ("phoner", "SYMPTOM_AND_DISEASE", None, "PROBLEM"),
    ("vimedner", "DISEASE_NAME", DIAGNOSIS, "PROBLEM"),
    ("vimedner", "SYMPTOM", SYMPTOM, "PROBLEM"),
    ("vimedner", "DIAGNOSTIC", TEST_NAME, "TEST"),
    ("vimedner", "TREATMENT", None, "TREATMENT"),
    ("vimedner", "CAUSE", None, None),
    ("vietbioner", "SYMPTOM_AND_DISEASE", None, "PROBLEM"),
    ("vietbioner", "DIAGNOSTIC_PROCEDURE", TEST_NAME, "TEST"),
    *(("vietbioner", x, None, "OTHER") for x in ("ORGANISATION", "LOCATION", "DATE_AND_TIME")),
    ("vimq", "SYMPTOM_AND_DISEASE", None, "PROBLEM"),
    ("vimq", "MEDICAL_ENTITY", None, "PROBLEM"),
    ("i2b2", "problem", None, "PROBLEM"),
    ("i2b2", "test", TEST_NAME, "TEST"),
    ("i2b2", "treatment", None, "TREATMENT"),
)

#: White space as the reference's regular expressions know it, in a class that Java and RE2 both take.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
