"""Small dimensions given in line; both are defaults of parameters."""

# Id, English, French and Arabic label of the specialties
SPECIALTIES = """
allergy_immunology|Allergy and Immunology|Allergie et Immunologie|الحساسية والمناعة
anesthesiology|Anesthesiology|Anesthésiologie|التخدير
cardiology|Cardiology|Cardiologie|أمراض القلب
cosmetic_dermatology|Cosmetic Dermatology|Dermatologie Esthétique|الجلدية التجميلية
dentistry|Dentistry|Dentisterie|طب الأسنان
dermatology|Dermatology|Dermatologie|الأمراض الجلدية
diabetes|Diabetes Mellitus|Diabétologie|مرض السكري
dietetics|Dietetics|Diététique|التغذية
endocrinology|Endocrinology|Endocrinologie|الغدد الصماء
general_practitioner|General Practice|Médecine Générale|الطب العام
gynecology|Gynecology|Gynécologie|أمراض النساء
hematology|Hematology|Hématologie|أمراض الدم
infectious_diseases|Infectious Diseases|Maladies Infectieuses|الأمراض المعدية
internal_diseases|Internal Medicine|Médecine Interne|الطب الداخلي
mental_health|Mental Health|Santé Mentale|الصحة النفسية
neurology|Neurology|Neurologie|الأعصاب
oncology|Oncology|Oncologie|الأورام
ophthalmology|Ophthalmology|Ophtalmologie|طب العيون
otorhinolaryngology|Otorhinolaryngology (ENT)|ORL|أمراض الأنف والأذن والحنجرة
pediatrics|Pediatrics|Pédiatrie|طب الأطفال
psychiatry|Psychiatry|Psychiatrie|الطب النفسي
respiratory|Respiratory Diseases|Maladies Respiratoires|أمراض الجهاز التنفسي
rheumatology|Rheumatology & Orthopedics|Rhumatologie et Orthopédie|الروماتيزم والعظام
andrology|Andrology|Andrologie|طب الذكورة
audiology|Audiology|Audiologie|علم السمع
bariatric_surgery|Bariatric Surgery|Chirurgie Bariatrique|جراحة السمنة
cardiothoracic_surgery|Cardiothoracic Surgery|Chirurgie Cardiothoracique|جراحة القلب والصدر
child_health|Child Health|Santé de l'Enfant|صحة الطفل
clinical_genetics|Clinical Genetics|Génétique Clinique|الوراثة السريرية
community_medicine|Community Medicine|Médecine Communautaire|طب المجتمع
critical_care|Critical Care|Soins Intensifs|العناية المركزة
endodontics|Endodontics|Endodontie|علاج جذور الأسنان
family_medicine|Family Medicine|Médecine Familiale|طب الأسرة
fetal_medicine|Fetal Medicine|Médecine Fœtale|طب الجنين
forensic_medicine|Forensic Medicine|Médecine Légale|الطب الشرعي
gastroenterology|Gastroenterology|Gastro-entérologie|أمراض الجهاز الهضمي
general_medicine|General Medicine|Médecine Générale|الطب العام
general_surgery|General Surgery|Chirurgie Générale|الجراحة العامة
geriatrics|Geriatrics|Gériatrie|طب الشيخوخة
hair_transplant|Hair Transplant Surgery|Greffe de Cheveux|زراعة الشعر
hiv_aids|HIV/AIDS Medicine|Médecine VIH/SIDA|طب الإيدز
infertility|Infertility|Infertilité|العقم
interventional_radiology|Interventional Radiology|Radiologie Interventionnelle|الأشعة التداخلية
microbiology|Microbiology|Microbiologie|علم الأحياء الدقيقة
nephrology|Nephrology|Néphrologie|أمراض الكلى
neurosurgery|Neurosurgery|Neurochirurgie|جراحة الأعصاب
nuclear_medicine|Nuclear Medicine|Médecine Nucléaire|الطب النووي
oral_maxillofacial_surgery|Oral & Maxillofacial Surgery|Chirurgie Maxillo-faciale|جراحة الوجه والفكين
orthodontics|Orthodontics|Orthodontie|تقويم الأسنان
orthopedics|Orthopedics & Traumatology|Orthopédie et Traumatologie|جراحة العظام
pain_medicine|Pain Medicine|Médecine de la Douleur|طب الألم
pathology|Pathology|Pathologie|علم الأمراض
pediatric_allergy|Pediatric Allergy & Asthma|Allergie et Asthme Pédiatrique|حساسية وربو الأطفال
pediatric_cardiology|Pediatric Cardiology|Cardiologie Pédiatrique|قلب الأطفال
pediatric_dentistry|Pediatric Dentistry|Dentisterie Pédiatrique|طب أسنان الأطفال
pediatric_surgery|Pediatric Surgery|Chirurgie Pédiatrique|جراحة الأطفال
periodontics|Periodontics|Parodontologie|أمراض اللثة
pharmacology|Pharmacology|Pharmacologie|علم الأدوية
plastic_surgery|Plastic Surgery|Chirurgie Plastique|الجراحة التجميلية
preventive_medicine|Preventive Medicine|Médecine Préventive|الطب الوقائي
radiation_oncology|Radiation Oncology|Radio-oncologie|علاج الأورام بالإشعاع
radiology|Radiology|Radiologie|الأشعة
sexology|Sexology|Sexologie|الطب الجنسي
sleep_medicine|Sleep Medicine|Médecine du Sommeil|طب النوم
spine_surgery|Spine Surgery|Chirurgie du Rachis|جراحة العمود الفقري
surgical_gastroenterology|Surgical Gastroenterology|Gastro-entérologie Chirurgicale|جراحة الجهاز الهضمي
surgical_oncology|Surgical Oncology|Oncologie Chirurgicale|جراحة الأورام
toxicology|Toxicology|Toxicologie|علم السموم
urology|Urology|Urologie|المسالك البولية
vascular_surgery|Vascular Surgery|Chirurgie Vasculaire|جراحة الأوعية الدموية
"""
# Rater profiles and the specialties that each judges
PROFILES = """
medecin_generaliste: general_practitioner, family_medicine, general_medicine
cardiologue: cardiology, cardiothoracic_surgery, hematology
pharma_etudiant_1: infectious_diseases, anesthesiology, allergy_immunology
pharma_etudiant_2: dentistry, endodontics, cosmetic_dermatology
etudiant_med_1: child_health, fetal_medicine, pediatric_allergy
etudiant_med_2: neurology, mental_health, geriatrics
etudiant_med_3: endocrinology, diabetes, dietetics
etudiant_med_4: gastroenterology, bariatric_surgery, general_surgery
etudiant_med_5: sleep_medicine, critical_care, otorhinolaryngology
etudiant_med_6: urology, nephrology, andrology
etudiant_med_7: orthopedics, spine_surgery, vascular_surgery
etudiant_med_8: ophthalmology, audiology, dermatology
etudiant_med_9: infectious_diseases, critical_care, microbiology
etudiant_med_10: surgical_oncology, pain_medicine, hematology
etudiant_med_11: gynecology, infertility, sexology
"""


def specialties(text: str = SPECIALTIES) -> list[tuple[str, str, str, str]]:
    return [tuple(line.split("|")) for line in text.strip().splitlines()]


def profiles(text: str = PROFILES) -> list[tuple[str, list[str]]]:
    return [(name, specs.split(", ")) for name, specs in (line.split(": ") for line in text.strip().splitlines())]
