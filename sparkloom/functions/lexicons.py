"""Word lists, patterns and parameters. Every operator takes them as arguments; these are the defaults."""

# Length bounds, sentence minimum and thin-answer cut of the pair validator
MIN_QUESTION, MAX_QUESTION, MIN_ANSWER, MAX_ANSWER = 40, 3000, 80, 5000
MIN_SENTENCES, THIN_ANSWER = 2, 160

# Refusal phrases
REFUSALS = [
    r"\bi am an ai\b",
    r"\bas an ai\b",
    r"\bi cannot provide\b",
    r"\bi'?m not a doctor\b",
    r"^\s*please consult a (licensed )?physician\.?$",
]

# Words that open a question
QUESTION_WORDS = [
    "what", "how", "why", "when", "where", "can", "is", "does",
    "do", "should", "could", "would", "are", "could", "qu'est",
    "comment", "pourquoi", "quand", "où", "est-ce", "puis-je",
    "ما", "هل", "كيف", "لماذا", "متى", "أين"
]

# Medical terms
MEDICAL_TERMS = [
    # EN
    "pain", "fever", "cough", "diabetes", "hypertension", "infection",
    "medication", "dose", "dosage", "mg", "symptom", "treatment", "diagnos",
    "cancer", "tumor", "surgery", "antibiotic", "vaccine", "blood", "heart",
    "lung", "kidney", "liver", "skin", "doctor", "patient", "hospital",
    "prescription", "side effect", "chronic", "acute",
    # FR
    "douleur", "fièvre", "toux", "diabète", "hypertension", "infection",
    "médicament", "posologie", "symptôme", "traitement", "diagnostic",
    "chirurgie", "antibiotique", "vaccin", "sang", "cœur", "poumon", "rein",
    "foie", "peau", "médecin", "patient", "hôpital",
    # AR
    "ألم", "حمى", "سعال", "سكري", "ضغط", "عدوى", "دواء", "جرعة", "عرض",
    "علاج", "تشخيص", "جراحة", "مضاد", "لقاح", "دم", "قلب", "رئة", "كلية",
    "كبد", "جلد", "طبيب", "مريض", "مستشفى",
]

# Dosages in monographs
MONOGRAPH_DOSAGE = (
    r"\b(\d+(?:[.,]\d+)?)\s?"
    r"(mg|g|µg|mcg|ug|UI|IU|ml|mL|%|cp|comprim[ée]s?|gouttes?|gél(?:ule|ules)?|sachets?|amp(?:\.|oule)s?)"
    r"(?:\s?/\s?(?:j|jour|24\s?h|kg|m2|prise))?",
)

# Routes of administration
ROUTES = [
    "voie orale", "per os", "po", "iv", "i.v.", "intraveineuse", "intraveineux",
    "im", "intramusculaire", "sc", "sous-cutan", "topique", "cutan",
    "rectale", "vaginale", "inhalation", "nasale", "ophtalmique", "sublingual",
]

# Phrases that introduce indications and contraindications
INDICATION_PHRASES = [
    "indiqué dans", "indication", "indications", "traitement de", "traitement du",
    "traitement des", "prévention", "prophylaxie",
]
CONTRAINDICATION_PHRASES = ["contre-indiqu", "contre-indication", "ne pas utiliser"]

# Symptoms and diseases in monographs
MONOGRAPH_SYMPTOMS = [
    "douleur", "douleurs", "fièvre", "céphalée", "céphalées", "migraine",
    "nausée", "nausées", "vomissement", "vomissements", "diarrhée", "constipation",
    "toux", "dyspnée", "asthénie", "anxiété", "insomnie", "vertige", "vertiges",
    "prurit", "œdème", "hypertension", "hypotension", "palpitations", "arythmie",
    "angine", "tachycardie", "bradycardie", "urticaire", "éruption",
]
MONOGRAPH_DISEASES = [
    "diabète", "hypertension", "insuffisance cardiaque", "angine de poitrine",
    "infarctus", "asthme", "bpco", "épilepsie", "dépression", "schizophrénie",
    "parkinson", "alzheimer", "ulcère", "gastrite", "reflux", "hépatite",
    "cirrhose", "pneumonie", "tuberculose", "méningite", "sinusite", "otite",
    "cystite", "pyélonéphrite", "infection urinaire", "infection respiratoire",
    "arthrose", "arthrite", "ostéoporose", "goutte", "psoriasis", "eczéma",
    "acné", "thyroïdie", "hypothyroïdie", "hyperthyroïdie", "anémie",
    "leucémie", "cancer", "lymphome",
]

# Symptoms and their spellings
SYMPTOMS = {
    "fever":                ["fever", "fièvre", "pyrexia", "fébrile", "حمى", "سخانة", "سخونة"],
    "pain":                 ["pain", "ache", "aching", "douleur", "ألم", "وجع"],
    "chest_pain":           ["chest pain", "thoracic pain", "douleur thoracique", "ألم في الصدر"],
    "headache":             ["headache", "migraine", "céphalée", "cephalalgia", "صداع"],
    "cough":                ["cough", "toux", "سعال", "كحة"],
    "dyspnea":              ["shortness of breath", "dyspnea", "dyspnée", "essoufflement", "صعوبة التنفس", "ضيق نفس"],
    "fatigue":              ["fatigue", "tired", "asthenia", "asthénie", "épuisement", "تعب", "إرهاق"],
    "nausea":               ["nausea", "nauseous", "nausée", "غثيان"],
    "vomiting":             ["vomit", "vomiting", "vomissement", "تقيؤ"],
    "diarrhea":             ["diarrhea", "diarrhoea", "diarrhée", "إسهال"],
    "constipation":         ["constipation", "إمساك"],
    "rash":                 ["rash", "éruption", "exanthème", "طفح جلدي"],
    "itching":              ["itching", "pruritus", "prurit", "حكة"],
    "weight_loss":          ["weight loss", "perte de poids", "نقص في الوزن"],
    "weight_gain":          ["weight gain", "prise de poids", "زيادة في الوزن"],
    "dizziness":            ["dizziness", "vertigo", "vertige", "étourdissement", "دوخة"],
    "chest_tightness":      ["chest tightness", "oppression thoracique", "ضيق في الصدر"],
    "palpitations":         ["palpitation", "خفقان"],
    "edema":                ["edema", "œdème", "oedème", "swelling", "تورم"],
    "syncope":              ["syncope", "fainting", "perte de conscience", "إغماء"],
    "anxiety":              ["anxiety", "anxiété", "قلق"],
    "depression":           ["depression", "depressed", "dépression", "اكتئاب"],
    "insomnia":             ["insomnia", "insomnie", "أرق"],
    "polyuria":             ["polyuria", "polyurie", "تبول متكرر"],
    "polydipsia":           ["polydipsia", "polydipsie", "عطش شديد"],
    "abdominal_pain":       ["abdominal pain", "stomach pain", "douleur abdominale", "ألم في البطن"],
    "joint_pain":           ["joint pain", "arthralgia", "douleur articulaire", "ألم في المفاصل"],
    "dysuria":              ["dysuria", "dysurie", "حرقان عند التبول"],
    "hematuria":            ["hematuria", "hématurie", "دم في البول"],
}

# Examinations and their spellings
EXAMS = {
    "ecg":                  ["ecg", "ekg", "électrocardiogramme", "electrocardiogram", "تخطيط القلب"],
    "blood_test":           ["blood test", "blood work", "cbc", "complete blood count",
                              "nfs", "numération", "hémogramme", "تحليل الدم"],
    "urine_test":           ["urinalysis", "urine test", "ecbu", "تحليل البول"],
    "ct_scan":              ["ct scan", "computed tomography", "scanner", "tdm", "tomodensitométrie"],
    "mri":                  ["mri", "magnetic resonance", "irm", "imagerie par résonance", "رنين مغناطيسي"],
    "x_ray":                ["x-ray", "xray", "radiographie", "radio", "أشعة"],
    "ultrasound":           ["ultrasound", "echo", "échographie", "تصوير بالأمواج فوق الصوتية"],
    "biopsy":                ["biopsy", "biopsie", "خزعة"],
    "endoscopy":            ["endoscopy", "endoscopie", "تنظير"],
    "colonoscopy":          ["colonoscopy", "coloscopie", "تنظير القولون"],
    "echocardiography":     ["echocardiography", "échocardiographie", "تخطيط صدى القلب"],
    "stress_test":          ["stress test", "épreuve d'effort", "اختبار الجهد"],
    "glycemia":             ["blood glucose", "glycemia", "glycémie", "hba1c", "السكر في الدم"],
    "lipid_panel":          ["lipid panel", "bilan lipidique", "cholesterol", "cholestérol"],
    "lumbar_puncture":      ["lumbar puncture", "ponction lombaire", "البزل القطني"],
    "spirometry":           ["spirometry", "spirométrie", "efr", "epreuves fonctionnelles", "قياس التنفس"],
    "tsh":                  ["tsh", "thyroid stimulating hormone", "tsh", "هرمون الغدة الدرقية"],
}

# Phrases that introduce a diagnosis
DIAGNOSIS_CUES = [
    "diagnosis:", "diagnostic :", "diagnostic:", "likely diagnosis", "diagnostic différentiel",
    "probable diagnosis", "diagnostic probable", "could be", "il s'agit probablement",
    "the condition is", "il pourrait s'agir", "الأرجح", "التشخيص"
]

# Keywords of groups of pathologies
PATHOLOGIES = {
    "cardiovascular":   ["heart", "cardio", "ischemic", "infarct", "myocard", "angina", "stroke", "avc",
                          "hypertension", "tachycardi", "bradycardi", "arrhythmi", "atrial fib",
                          "ventricular", "hypertensi", "fibrillation", "thrombos",
                          "chest pain", "douleur thoracique", "st elevation", "st-elevation",
                          "valvular", "valvulair", "embolism", "embolie",
                          "ihme", "qlb", "قلب", "ضغط الدم", "احتشاء"],
    "infectious":       ["infection", "infectious", "bacterial", "viral", "sepsis", "pneumonia",
                          "pneumonie", "tuberculosis", "tuberculose", "covid", "hiv", "vih",
                          "fever", "fièvre", "abscess", "abcès", "antibiotique", "antibiotic",
                          "تعفن", "عدوى", "حمى", "السيدا"],
    "endocrine":        ["diabet", "diabète", "thyroid", "thyroïd", "hba1c", "insulin", "insuline",
                          "hyperthyr", "hypothyr", "endocrin", "السكري", "الغدة"],
    "respiratory":      ["asthma", "asthme", "copd", "bpco", "pneumonia", "pneumonie", "bronchit",
                          "respirator", "lung", "poumon", "respirat", "تنفس", "ربو"],
    "gastrointestinal": ["ulcer", "ulcère", "gastrit", "reflux", "rgo", "diarrhea", "diarrhée",
                          "constipat", "ibs", "crohn", "colit", "hépatit", "hepatit", "appendic",
                          "معدة", "إسهال", "إمساك"],
    "neurological":     ["seizure", "epileps", "épileps", "parkinson", "alzheimer", "stroke",
                          "avc", "migraine", "headache", "céphalée", "neuropath", "encephal",
                          "تشنج", "صرع", "صداع"],
    "musculoskeletal":  ["arthritis", "arthrite", "osteoarthr", "rheumat", "rhumat", "fracture",
                          "tendin", "ligament", "back pain", "lombalgie", "ألم العظام", "كسر"],
    "psychiatric":      ["depression", "dépression", "anxiety", "anxiété", "bipolar", "bipolaire",
                          "schizophr", "ptsd", "psychos", "ocd", "tdah", "اكتئاب", "قلق"],
    "renal":            ["kidney", "rein", "renal", "rénal", "nephr", "néphr", "uremia",
                          "dialys", "كلية"],
    "oncology":         ["cancer", "tumor", "tumeur", "leukemi", "leucémie", "lymphom",
                          "metastas", "métastas", "chemo", "chimio", "ورم", "سرطان"],
    "dermatology":      ["rash", "éruption", "eczema", "eczéma", "psoriasis", "acne", "acné",
                          "dermatit", "dermatos", "طفح", "إكزيما"],
    "obgyn":            ["pregnan", "grossesse", "menstruat", "règles", "obstetric", "obstétr",
                          "gynecolog", "gynécolog", "menopaus", "ménopaus", "الحمل", "دورة"],
    "pediatrics":       ["pediatr", "pédiatr", "newborn", "nouveau-né", "infant", "nourrisson",
                          "vaccination", "vaccin", "أطفال", "رضيع"],
    "allergy_immuno":   ["allerg", "anaphyl", "auto-immun", "autoimmun", "lupus", "rheumat", "vasculit"],
}
