"""Fixed values of the item classifier: forms, standards, material grades, codes by form, signs and rules.

All of them are values that results depend on, stated as they are. Grades and rules are tried in this
order and the first that matches counts, so the order is part of the values.
"""

FORMS = ["Плита", "Лист", "Круг", "Пруток", "Лента", "Полоса", "Профиль", "Швеллер", "Двутавр", "Уголок", "Балка", "Труба", "Квадрат", "Шестигранник", "Болт", "Винт", "Гайка", "Шайба", "Штифт", "Шпилька", "Заготовка", "Отливка", "Поковка", "Проволока", "Канат", "Трос", "Сетка"]

#: Standard number (ГОСТ): product code.
GOST_CODES = {
    "103": "24.10.62.124", "494": "24.44.24.110", "597": "17.12.14.120", "701": "20.15.10.110", "859": "24.44.13.120", "931": "24.44.24.120",
    "1207": "25.94.11.120", "1491": "25.94.11.120", "1535": "24.44.22.110", "2009": "25.94.11.120", "2010": "25.94.11.120", "2060": "24.44.13.120",
    "2184": "20.13.24.122", "2210": "20.15.20.110", "2284": "24.32.10.000", "2567": "20.13.24.141", "2590": "24.10.62.121", "2591": "24.10.62.122",
    "2603": "20.14.62.000", "2622": "24.44.22.110", "2718": "22.21.30.110", "2768": "20.14.62.000", "2824": "17.12.14.179", "3032": "25.94.11.130",
    "3057": "25.94.12.144", "3118": "20.13.24.112", "3128": "25.94.12.190", "3129": "25.94.12.190", "3441": "17.12.14.170", "4014": "25.94.11.110",
    "4017": "25.94.11.110", "4018": "25.94.11.120", "4028": "25.94.12", "4029": "25.94.12", "4032": "25.94.11.130", "4165": "20.13.41.130",
    "4204": "20.13.24.122", "4598": "16.21.14.000", "4986": "24.32.10.000", "5582": "24.10.42.000", "5915": "25.94.11.130", "5916": "25.94.11.130",
    "5927": "25.94.11.130", "5950": "24.10.36", "6221": "20.15.10.120", "6402": "25.94.12.110", "6465": "20.30.12", "6709": "20.13.52.120",
    "6958": "25.94.12.110", "7376": "17.21.11.110", "7417": "24.31.10.110", "7796": "25.94.11.110", "7798": "25.94.11.110", "7805": "25.94.11.110",
    "7808": "25.94.11.110", "8050": "20.11.12.110", "8239": "24.10.71.120", "8240": "24.10.71.130", "8273": "17.12.14.190", "8486": "16.10.10",
    "8509": "24.10.71.111", "8510": "24.10.71.112", "8617": "24.42.22.130", "8731": "24.20.13.110", "8732": "24.20.13.110", "8733": "24.20.13.140",
    "8734": "24.20.13.140", "8765": "25.94.11.110", "8981": "20.14.32.123", "9109": "20.30.12", "9433": "19.20.29.210", "9546": "20.13.31.000",
    "9569": "17.12.14.172", "10157": "20.11.11", "10299": "25.94.12.120", "10300": "25.94.12.120", "10301": "25.94.12.120", "10317": "26.12.10",
    "10434": "27.33.13.120", "10450": "25.94.12.110", "10597": "32.91.12.110", "10605": "25.94.11.130", "11159": "20.13.31.000", "11326": "27.32.12.000",
    "11326.3": "27.32.12.000", "11326.37": "27.32.12.000", "11326.74": "27.32.12.000", "11371": "25.94.12.110", "11648": "25.94.12.110", "11738": "25.94.11.120",
    "12026": "17.12.14.140", "12638": "25.94.12", "12639": "25.94.12", "12641": "25.94.12", "12707": "20.30.12", "13737": "24.42.24.120",
    "13738": "24.42.22.130", "13827": "13.95.10.110", "14637": "24.10.31.000", "15589": "25.94.11.110", "15590": "25.94.11.110", "16214": "27.33.14",
    "17020": "25.72.14.190", "17232": "24.42.24.110", "17473": "25.94.11.120", "17475": "25.94.11.120", "19113": "20.14.71.171", "19903": "24.10.31.000",
    "19904": "24.10.41.000", "20490": "20.13.51.113", "21488": "24.42.22.110", "21631": "24.42.24.110", "21930": "24.43.24", "21931": "24.43.24",
    "22233": "24.42.22.130", "22375": "27.33.13", "24454": "16.10.10", "25718": "20.30.12", "26020": "24.10.71.120", "58144": "20.13.52.120",
}
DIN_CODES = {"125": "25.94.12.110", "127": "25.94.12.110", "912": "25.94.11.120", "913": "25.94.11.120", "933": "25.94.11.110", "934": "25.94.11.130", "7980": "25.94.12.110", "7989": "25.94.12.110"}
ISO_CODES = {"2010": "25.94.11.120", "4014": "25.94.11.110", "4017": "25.94.11.110", "4018": "25.94.11.120", "4032": "25.94.11.130", "7089": "25.94.12.110", "7090": "25.94.12.110"}

_AL = r"\b(?:EN\s*AW|AA|Al(?:uminium|uminum)?|АЛЮМИНИЙ)\s*[-/]?\s*"
_CU = r"(?:медь|cu)"
#: (pattern, product code, name; $1 is the pattern's group).
GRADES = [
    (r"\b17Г1С(У)?\b", "24.10.32", "сталь 17Г1С/17Г1СУ"),
    (r"\b10ХСНД\b|\b15ХСНД\b", "24.10.32", "сталь атмосферостойкая 10ХСНД/15ХСНД"),
    (r"\b70Г\b", "24.10.32", "сталь пружинная 70Г"),
    (r"\b55С2\b", "24.10.32", "сталь пружинная 55С2"),
    (r"\bШХ15СГ?\b", "24.10.32", "сталь подшипниковая ШХ15СГ"),
    (r"\b100Cr6\b", "24.10.32", "подшипниковая сталь 100Cr6 (≈ШХ15)"),
    (r"\b52100\b", "24.10.32", "подшипниковая сталь AISI 52100"),
    (r"\bХН60Ю\b|\bХН65МВ\b|\bХН73МБТЮ\b", "24.45", "жаропрочный никелевый сплав"),
    (r"\bХН70ВМТЮ\b", "24.45", "жаропрочный никелевый сплав ХН70ВМТЮ"),
    (r"\bХН50ВМТЮБ\b", "24.45", "жаропрочный никелевый сплав ХН50ВМТЮБ"),
    (r"\bХН77ТЮР\b", "24.45", "жаропрочный никелевый сплав ХН77ТЮР"),
    (r"\bХН35ВТЮ\b", "24.45", "жаропрочный никелевый сплав ХН35ВТЮ"),
    (r"\bЭИ\d{3}\b", "24.45", "жаропрочный сплав серии ЭИ"),
    (r"\bЭП\d{3}\b", "24.45", "жаропрочный сплав серии ЭП"),
    (r"\bInconel\s*(625|718|600)\b", "24.45", "Inconel $1"),
    (r"\bHastelloy\s*(C-?276|C22)\b", "24.45", "Hastelloy $1"),
    (r"\bMonel\s*400\b", "24.45", "Monel 400"),
    (r"\bВТ5-1\b", "24.45.30", "титановый сплав ВТ5-1"),
    (r"\bВТ6\b", "24.45.30", "титановый сплав ВТ6"),
    (r"\bВТ9\b", "24.45.30", "титановый сплав ВТ9"),
    (r"\bВТ14\b", "24.45.30", "титановый сплав ВТ14"),
    (r"\bВТ16\b", "24.45.30", "титановый сплав ВТ16"),
    (r"\bПТ7М\b", "24.45.30", "титановый сплав ПТ7М"),
    (r"\bЛС59-1\b", "24.44", "латунь ЛС59-1"),
    (r"\bCW(614N|508L|612N)\b", "24.44", "латунь EN CW$1"),
    (r"\bCuZn(37|39Pb3)\b", "24.44", "латунь CuZn$1"),
    (r"\bБрО10Ф1\b|\bБрОЦС5-5-5\b|\bБрАЖ9-4\b|\bБрАЖМц10-3-1\.5\b", "24.44", "бронза деформируемая"),
    (r"\bСв-?08Г2С\b", "24.34.13.120", "проволока сварочная Св-08Г2С"),
    (r"\b09Г2С\b", "24.10.32", "сталь низколегированная 09Г2С"),
    (r"\b09G2S\b", "24.10.32", "сталь низколегированная 09G2S"),
    (r"\b65Г\b", "24.10.32", "сталь пружинная 65Г"),
    (r"\b60С2А\b", "24.10.32", "сталь пружинная 60С2А"),
    (r"\bШХ15\b", "24.10.32", "сталь подшипниковая ШХ15"),
    (r"\b18ХГТ\b", "24.10.32", "сталь легированная 18ХГТ"),
    (r"\b12ХН3А\b", "24.10.32", "сталь легированная 12ХН3А"),
    (r"\b20ХН3А\b", "24.10.32", "сталь легированная 20ХН3А"),
    (r"\b38Х2МЮА\b", "24.10.32", "сталь легированная 38Х2МЮА"),
    (r"\b40ХГ\b", "24.10.32", "сталь легированная 40ХГ"),
    (r"\b(?:сталь\s*)?40Х", "24.10.32", "сталь легированная 40Х"),
    (r"\b(?:сталь\s*)?45Х", "24.10.32", "сталь легированная 45Х"),
    (r"\b(?:сталь\s*)?30ХГСА", "24.10.32", "сталь легированная 30ХГСА"),
    (r"\b(?:сталь\s*)?40ХН", "24.10.32", "сталь легированная 40ХН"),
    (r"\b30[ХX]2[НNH]2[ВVB][ФF][МM][АA]\b", "24.10.32", "сталь высоколегированная 30Х2Н2ВФМА"),
    (r"\b38ХН3МА\b", "24.10.32", "сталь легированная 38ХН3МА"),
    (r"\b40ХН2МА\b", "24.10.32", "сталь легированная 40ХН2МА"),
    (r"\b40ХНМА\b", "24.10.32", "сталь легированная 40ХНМА"),
    (r"\bВТ1(?:-0)?\b", "24.45.30", "титан технический ВТ1-0"),
    (r"\bВТ3-1\b", "24.45.30", "титановый сплав ВТ3-1"),
    (r"\bВТ22\b", "24.45.30", "титановый сплав ВТ22"),
    (r"\bВТ23\b", "24.45.30", "титановый сплав ВТ23"),
    (r"\bОТ4-1\b", "24.45.30", "титановый сплав ОТ4-1"),
    (r"\bЛС58-2\b", "24.44", "латунь свинцовая ЛС58-2"),
    (r"\bБрБ[12]\b", "24.44.21", "бронза бериллиевая БрБ"),
    (r"\bБрКМц[0-9\-]+", "24.44.21", "бронза кремнисто-марганцевая"),
    (r"\bСт\.?\s*0", "24.10.61", "сталь углеродистая Ст0"),
    (r"\bСт\.?\s*3(?:сп|пс|кп)?", "24.10.61", "сталь углеродистая Ст3"),
    (r"\bСт\.?\s*4(?:сп|пс|кп)?", "24.10.61", "сталь углеродистая Ст4"),
    (r"\bСт\.?\s*5(?:сп|пс|кп)?", "24.10.61", "сталь углеродистая Ст5"),
    (r"\b(?:сталь\s*)?(?:10|15|20|25|30|35|40|45|50|55|60|65|70)\b", "24.10.62", "сталь углеродистая качественная"),
    (r"\b12Х18Н10Т", "24.10.22", "сталь коррозионностойкая 12Х18Н10Т"),
    (r"\b12Х18Н9Т", "24.10.22", "сталь коррозионностойкая 12Х18Н9Т"),
    (r"\b08Х18Н10", "24.10.22", "сталь коррозионностойкая 08Х18Н10"),
    (r"\b08Х18Н10Т", "24.10.22", "сталь коррозионностойкая 08Х18Н10Т"),
    (r"\b10Х17Н13М2Т", "24.10.22", "сталь коррозионностойкая 10Х17Н13М2Т"),
    (r"\b07Х16Н6", "24.10.22", "сталь коррозионностойкая 07Х16Н6"),
    (r"\b20Х13", "24.10.22", "сталь коррозионностойкая 20Х13"),
    (r"\b30Х13", "24.10.22", "сталь коррозионностойкая 30Х13"),
    (r"\b40Х13", "24.10.22", "сталь коррозионностойкая 40Х13"),
    (r"\b95Х18", "24.10.22", "сталь коррозионностойкая 95Х18"),
    (r"\b07Х12НМБФ", "24.10.22", "сталь коррозионностойкая 07Х12НМБФ"),
    (r"\b(12Х18Н10Т|12Х18Н9Т|08Х18Н10Т?|10Х17Н13М2Т|07Х16Н6|20Х13|30Х13|40Х13|95Х18|07Х12НМБФ|12Х17|08Х17|14Х17Н2)\b", "24.10.22", "сталь коррозионностойкая $1"),
    (r"\b(12X18H10T|08X18H10|10X17H13M2T)\b", "24.10.22", "сталь коррозионностойкая $1"),
    (r"\bAISI\s*430\b", "24.10.22", "нерж. сталь AISI 430"),
    (r"\bAISI\s*409\b", "24.10.22", "нерж. сталь AISI 409"),
    (r"\bAISI\s*410\b", "24.10.22", "нерж. сталь AISI 410"),
    (r"\bAISI\s*420\b", "24.10.22", "нерж. сталь AISI 420"),
    (r"\bAISI\s*904L\b", "24.10.22", "нерж. сталь AISI 904L"),
    (r"\b17[- ]?4\s*PH\b|\bAISI\s*630\b", "24.10.22", "нерж. стареющая 17-4PH (AISI 630)"),
    (r"\b15[- ]?5\s*PH\b", "24.10.22", "нерж. стареющая 15-5PH"),
    (r"\b1\.(4571|4462|4410)\b", "24.10.22", "нержавеющая сталь EN 1.$1"),
    (r"\bduplex\b|\bsuper\s*duplex\b", "24.10.22", "нержавеющая Duplex"),
    (r"\bX\dCrNi\d{2}-\d{1,2}\b", "24.10.22", "нерж. по EN (X…CrNi…)"),
    (r"\b12Х18Н10Т\b", "24.10.22", "сталь коррозионностойкая 12Х18Н10Т"),
    (r"\b12Х18Н9Т\b", "24.10.22", "сталь коррозионностойкая 12Х18Н9Т"),
    (r"\b08Х18Н10\b", "24.10.22", "сталь коррозионностойкая 08Х18Н10"),
    (r"\b08Х18Н10Т\b", "24.10.22", "сталь коррозионностойкая 08Х18Н10Т"),
    (r"\b10Х17Н13М2Т\b", "24.10.22", "сталь коррозионностойкая 10Х17Н13М2Т"),
    (r"\b07Х16Н6\b", "24.10.22", "сталь коррозионностойкая 07Х16Н6"),
    (r"\b20Х13\b", "24.10.22", "сталь коррозионностойкая 20Х13"),
    (r"\b30Х13\b", "24.10.22", "сталь коррозионностойкая 30Х13"),
    (r"\b40Х13\b", "24.10.22", "сталь коррозионностойкая 40Х13"),
    (r"\b95Х18\b", "24.10.22", "сталь коррозионностойкая 95Х18"),
    (r"\b07Х12НМБФ\b", "24.10.22", "сталь коррозионностойкая 07Х12НМБФ"),
    (r"\b12Х17\b", "24.10.22", "сталь коррозионностойкая 12Х17"),
    (r"\b08Х17\b", "24.10.22", "сталь коррозионностойкая 08Х17"),
    (r"\b14Х17Н2\b", "24.10.22", "сталь коррозионностойкая 14Х17Н2"),
    (r"\b12X18H10T\b", "24.10.22", "12Х18Н10Т (лат.)"),
    (r"\b08X18H10\b", "24.10.22", "08Х18Н10 (лат.)"),
    (r"\b10X17H13M2T\b", "24.10.22", "10Х17Н13М2Т (лат.)"),
    (r"\bAISI\s*304(L)?\b", "24.10.22", "AISI 304/304L"),
    (r"\bAISI\s*316(L)?\b", "24.10.22", "AISI 316/316L"),
    (r"\bAISI\s*321\b", "24.10.22", "AISI 321"),
    (r"\bA[24][- ]?\d{2}\b", "24.10.22", "класс A2/A4 (≈304/316)"),
    (r"\b1\.(4301|4307|4541|4401|4404|4016)\b", "24.10.22", "нерж. по EN"),
    (r"\bУ7А?", "24.10.36", "сталь инструментальная У7"),
    (r"\bУ8А?", "24.10.36", "сталь инструментальная У8"),
    (r"\bУ10А?", "24.10.36", "сталь инструментальная У10"),
    (r"\bУ12А?", "24.10.36", "сталь инструментальная У12"),
    (r"\bХВГ", "24.10.36", "сталь инструментальная ХВГ"),
    (r"\bХ12М", "24.10.36", "сталь инструментальная Х12М"),
    (r"\bХ12МФ", "24.10.36", "сталь инструментальная Х12МФ"),
    (r"\bХ12Ф1", "24.10.36", "сталь инструментальная Х12Ф1"),
    (r"\b9ХС", "24.10.36", "сталь инструментальная 9ХС"),
    (r"\b6ХВ2С", "24.10.36", "сталь инструментальная 6ХВ2С"),
    (r"\bР6М5", "24.10.36", "сталь быстрорежущая Р6М5"),
    (r"\bР18", "24.10.36", "сталь быстрорежущая Р18"),
    (r"\bАМц\b", "24.42", "алюминиевый сплав АМц"),
    (r"\b1561[БМ]?\b", "24.42", "алюминиевый сплав 1561"),
    (r"\b1163[АТ]?\b", "24.42", "алюминиевый сплав 1163"),
    (r"\bВ95(?:пч)?(?:[-\s]?Т[1-3])?\b", "24.42", "алюминиевый сплав В95"),
    (r"\bД1(?:[АТ])?\b", "24.42", "алюминиевый сплав Д1"),
    (r"\bАК[47](?:ч)?(?:-1)?\b", "24.42", "алюминиевый сплав АК"),
    (r"\bАД0\b", "24.42", "алюминий технический АД0"),
    (r"\bАД1\b", "24.42", "алюминий технический АД1"),
    (r"\bАД31\b", "24.42", "алюминиевый сплав АД31"),
    (_AL + r"(1050A|1100|3003|3004|5083|5086|5754|6060|6061|6063|6082|7075)\b(?:[-\s]?(?:T|H)\d\w*)?", "24.42", "алюминиевый сплав (EN/AA/Al)"),
    (r"\bEN\s*AW[- ]?(2024|2017A|1100|3004|5086)(?:[-\s]?[HT]\d\w*)?\b", "24.42", "алюминиевый сплав EN AW-$1"),
    (r"\bАМг[23456]М?\b", "24.42", "алюминиевый сплав АМг"),
    (r"\bД16(?:[АТ])?\b", "24.42", "алюминиевый сплав Д16"),
    (r"\bАД3[135]\b", "24.42", "алюминиевый сплав АД31/АД33/АД35"),
    (r"\bЛатунь", "24.44", "латунь"),
    (r"\bЛ(?:63|68|70)\b", "24.44", "латунь"),
    (r"\bЛС59", "24.44.13", "латунь ЛС59"),
    (r"\bБрАЖ", "24.44.21", "бронза алюминиево-железная"),
    (r"\bБрОФ", "24.44.21", "бронза оловянно-фосфористая"),
    (r"\bБрОЦС", "24.44.21", "бронза оловянно-цинково-свинцовая"),
    (rf"(?:{_CU}\s*[:\-]?\s*[mм][123]\b|\b[mм][123]\b\s*(?:{_CU})|\bмарка\s*[mм][123]\b)", "24.44", "медь (М1/М2/М3)"),
    (r"\bВТ[156]\b", "24.45.30", "титановый сплав ВТ"),
    (r"\bВТ20", "24.45.30", "титановый сплав ВТ20"),
    (r"\bОТ4", "24.45.30", "титановый сплав ОТ4"),
    (r"\bПТ(?:7М|-\d+)?\b", "24.45.30", "титановый сплав ПТ"),
]
#: Case-sensitive patterns of grades that aren't listed; the group is the grade.
OTHER_GRADES = [r"\b([А-Я]{1,3}\d+[А-Я]*(?:-[А-Я]+)?)\b", r"\b(\d{4}[А-Я]?)\b", r"\b(\d{1,2}[ХX][\dА-Я]+)\b"]

# Patterns of sizes, standards and finishes
STEEL = r"\b(Ст\.?\s*\d+\w*)\b"
FLAT_SIZE = r"(\d+(?:[.,]\d+)?)\s*[xх×]\s*(\d+(?:[.,]\d+)?)"
SHAPED_SIZE = r"(\d+)[xх](\d+)(?:[xх](\d+))?"
THREAD_SIZE = r"М(\d+)(?:[xх](\d+))?"
FIRST_NUMBER = r"(?:^|\s)(\d+(?:[.,]\d+)?)\b"
ROUND_SIZE = r"(?:^|\s|Ø|D|d)(\d+(?:[,\.]\d+)?)\b"
WIDTH_SAID = r"шир(?:\.|ина)?\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*(?:мм|mm)\b"
TU = r"ТУ\s*([\d\-\.]+)"
OST = r"ОСТ\s*([\d\s\-]+)"
DIN = r"DIN\s*(\d+)"
ISO = r"ISO\s*(\d+(?:[-\.]\d+)?)"
SURFACE = r"\b(?:шлифован|полирован|матов)\w*\b"
HEAT_TREATMENT = r"\b(?:закален|отожжен|норм(?:ализ)?)\w*\b"
COATING = r"\b(?:оцинкован|хромирован|никелирован|кадмирован)\w*\b"

FAMILY_NAMES = {"AL": "алюминий", "CU": "медь/латунь", "SS": "нерж. сталь", "FE": "сталь", "NI": "Ni-сплав", "FEA": "легир. сталь"}
#: Product code by material family and form.
FAMILY_FORMS = {
    "AL": {"ПЛИТА": "24.42.24", "ЛИСТ": "24.42.24", "ПОЛОСА": "24.42.24", "ЛЕНТА": "24.42.24", "КРУГ": "24.42.22", "ПРУТОК": "24.42.22", "ПРОФИЛЬ": "24.42.22", "УГОЛОК": "24.42.22", "ШВЕЛЛЕР": "24.42.22", "ТРУБА": "24.42.26", "ПРОВОЛОКА": "24.42.23"},
    "CU": {"ПЛИТА": "24.44.24", "ЛИСТ": "24.44.24", "ПОЛОСА": "24.44.24", "ЛЕНТА": "24.44.24", "КРУГ": "24.44.22", "ПРУТОК": "24.44.22", "ПРОФИЛЬ": "24.44.22", "ТРУБА": "24.44.26", "ПРОВОЛОКА": "24.44.23"},
    "SS": {"КРУГ": "24.10.64", "ПРУТОК": "24.31.30", "ПОЛОСА": "24.10.64", "УГОЛОК": "24.10.71", "ШВЕЛЛЕР": "24.10.71", "ДВУТАВР": "24.10.71", "ТРУБА": "24.20"},
    "NI": {"ПЛИТА": "24.45.24", "ЛИСТ": "24.45.24", "ЛЕНТА": "24.45.24", "КРУГ": "24.45.22", "ПРУТОК": "24.45.22", "ПРОВОЛОКА": "24.45.22", "ПРОФИЛЬ": "24.45.22", "ТРУБА": "24.45.26"},
    "FE": {"КРУГ": "24.10.62", "ПРУТОК": "24.31.10", "КВАДРАТ": "24.10.62", "ШЕСТИГРАННИК": "24.10.62", "ПОЛОСА": "24.10.62", "ПРОФИЛЬ": "24.10.71", "УГОЛОК": "24.10.71", "ШВЕЛЛЕР": "24.10.71", "ДВУТАВР": "24.10.71", "БАЛКА": "24.10.71", "ТРУБА": "24.20", "ПРОВОЛОКА": "24.34"},
}
#: Product code by form alone.
FORM_CODES = {
    "ПЛИТА": "24.10.31.000", "ЛИСТ": "24.10.41.000", "КРУГ": "24.10.62.121", "ПРУТОК": "24.31.10.110", "КВАДРАТ": "24.10.62.122", "ШЕСТИГРАННИК": "24.10.62.123",
    "ПОЛОСА": "24.10.62.124", "ЛЕНТА": "24.32.10.000", "ПРОФИЛЬ": "24.10.71", "УГОЛОК": "24.10.71", "ШВЕЛЛЕР": "24.10.71", "ДВУТАВР": "24.10.71", "БАЛКА": "24.10.71",
    "ТРУБА": "24.20", "БОЛТ": "25.94.11.110", "ВИНТ": "25.94.11.120", "ГАЙКА": "25.94.11.130", "ШАЙБА": "25.94.12.110", "ШТИФТ": "25.94.12.190", "ШПИЛЬКА": "25.94.11.140",
    "ЗАГОТОВКА": "24.10.21.190", "ОТЛИВКА": "24.10.21.190", "ПОКОВКА": "24.10.21.142", "ПРОВОЛОКА": "24.34", "КАНАТ": "25.93.11.120", "ТРОС": "25.93.11.120", "СЕТКА": "25.93.13",
}

#: Substrings of a material's name (upper case) and code beginnings that decide its family; the first row that holds counts.
FAMILIES = [
    ("AL", "24.42", ["АМГ", "АМЦ", "АД", "АК", "Д16", "В95", "1561", "1163", "6061", "6063", "7075"]),
    ("CU", "24.44", ["ЛАТУН", "БРОНЗ", "МЕДЬ", "М1", "М2", "М3", "Л63", "Л68", "ЛС59"]),
    ("NI", "24.45", ["INCONEL", "HASTELLOY", "MONEL", "ХН", "ЭИ", "ЭП"]),
    ("SS", None, ["AISI"]),
    ("FEA", None, ["ЛЕГИРОВАН", "ПРУЖИН", "ПОДШИПНИК", "ХН", "ХГСА"]),
]
STAINLESS = r"\b1\.\d{4}\b|\d+[ХX]\d+[НH]\d+"

#: Patterns over the whole text, without regard to case.
SIGNS = {
    "needle_series": r"\bподшипник\w*\b.*\b(?:NA\d|NK\d|HK\d|RNA\d|NKI\d|NKIS\d)\b",
    "needle_bearing": r"\bподшипник\w*\s*(?:качени[яй]\s*)?(?:ролик\w*\s*)?игольчат\w*",
    "needle_roller": r"\b(?:игольчат\w*\s*ролик\w*|ролик\w*\s*игольчат\w*)\b",
    "valve": r"\b(?:вентил\w*|клапан\w*|задвижк\w*|кран\w*)\b",
    "piped": r"\b(?:DN|Д[Уу]|ДУ)\s*\d+\b|резьб\w+|муфтов\w+|фланцев\w+|трубопровод\w+",
    "cold_word": r"\b(?:х/к|хк|холоднокатан\w*)\b",
    "hot_word": r"\b(?:г/к|гк|горячекатан\w*)\b",
    "strip": r"\bштрипс\w*\b",
    "solder": r"припой|\bПОС[КС]?(?:[-\s]?\d{2}(?:-\d{1,2})?)?\b",
    "tool": "модельная оснастка",
    "wooden": "дерево",
    "tip": "наконечник",
    "brass": "латунь",
}

#: The decision list: (condition, code, confidence, description), SQL over the columns that ``classify`` binds.
RULES = [
    ("needle_series", "'28.15.10.128'", "0.94", "'подшипник игольчатый (серии NA/NK/HK/…)'"),
    ("needle_bearing", "'28.15.10.128'", "0.96", "'подшипник игольчатый'"),
    ("needle_roller", "'28.15.31.120'", "0.95", "'ролики игольчатые (детали подшипников)'"),
    ("valve AND piped", "'28.14.12'", "0.92", "'трубопроводная арматура (вентиль/клапан/задвижка/кран)'"),
    # form and material together
    ("family IS NOT NULL AND deeper", "material_code", "0.95", "kind || ' из ' || material"),
    ("base IS NOT NULL AND form NOT IN ('ЛЕНТА', 'ЛИСТ', 'ПЛИТА')", "base", "0.90", "kind || ' (' || family_name || ')'"),
    ("band AND family = 'AL' AND width >= 600", "'24.42.24.110'", "0.95", "'лист ' || metal || ' ≥600 мм'"),
    ("band AND family = 'CU' AND width >= 600", "'24.44.24.110'", "0.95", "'лист ' || metal || ' ≥600 мм'"),
    ("band AND family = 'AL' AND width < 600", "'24.42.24.120'", "0.96", "'полоса/лента ' || metal || ' <600 мм'"),
    ("band AND family = 'CU' AND width < 600", "'24.44.24.120'", "0.96", "'полоса/лента ' || metal || ' <600 мм'"),
    ("band AND family = 'AL'", "'24.42.24.120'", "0.88", "'лента ' || metal || ' (толщ. >0,2 мм), ширина не указана'"),
    ("band AND family = 'CU'", "'24.44.24.120'", "0.88", "'лента ' || metal || ' (толщ. >0,2 мм), ширина не указана'"),
    ("band AND family = 'NI'", "'24.45.24'", "0.93", "'лента/лист Ni-сплав (24.45.24)'"),
    ("band AND width >= 600 AND cold", "CASE WHEN family = 'SS' THEN '24.10.42.000' ELSE '24.10.41.000' END", "0.94", "'лист х/к ≥600 мм (' || metal || ')'"),
    ("band AND width >= 600 AND NOT hot", "CASE WHEN family = 'SS' THEN '24.10.42.000' ELSE '24.10.41.000' END", "0.90", "'лист х/к ≥600 мм (' || metal || ')'"),
    ("band AND width >= 600", "CASE WHEN family = 'SS' THEN '24.10.33.000' ELSE '24.10.31.000' END", "0.94", "'лист г/к ≥600 мм (' || metal || ')'"),
    ("band AND width < 600 AND (cold OR narrow OR strip)", "'24.32.10.000'", "0.96", "'узкая лента/штрипс <600 мм (' || metal || ')'"),
    ("band AND width < 600", "'24.32.10.000'", "0.90", "'узкая лента/штрипс <600 мм (' || metal || ')'"),
    ("band", "'24.32.10.000'", "0.88", "'лента (' || metal || '), ширина не указана'"),
    ("sheet AND family IN ('AL', 'CU', 'NI')", "base", "0.90", "kind || ' ' || metal"),
    ("sheet AND family = 'SS' AND (cold OR NOT hot)", "'24.10.42.000'", "sheet_conf", "kind || ' (' || metal || ')'"),
    ("sheet AND family = 'SS'", "'24.10.33.000'", "sheet_conf", "kind || ' (' || metal || ')'"),
    ("sheet AND (cold OR NOT hot)", "'24.10.41.000'", "sheet_conf", "kind || ' (' || metal || ')'"),
    ("sheet", "'24.10.31.000'", "sheet_conf", "kind || ' (' || metal || ')'"),
    # solder
    ("solder AND form = 'ПРОВОЛОКА'", "'24.43.24.130'", "0.94", "'припой, проволока'"),
    ("solder AND form IN ('ПРУТОК', 'КРУГ')", "'24.43.24.110'", "0.94", "'припой, пруток'"),
    ("solder AND form IN ('ЛЕНТА', 'ПРОФИЛЬ', 'ПОЛОСА', 'ТРУБА')", "'24.43.24.120'", "0.92", "'припой, лента/профиль'"),
    ("solder", "'24.43.24'", "0.88", "'припой (форма не указана)'"),
    # material alone, standards, form alone, special cases
    ("material IS NOT NULL AND form IS NULL", "'UNSURE'", "0.40", "'Определён материал: ' || material || '. Форма не указана — код зависит от формы (лист/пруток/лента/проволока/труба).'"),
    ("gost_code IS NOT NULL", "gost_code", "0.93", "'ГОСТ ' || gost_number"),
    ("din_code IS NOT NULL", "din_code", "0.92", "'DIN ' || din"),
    ("iso_code IS NOT NULL", "iso_code", "0.92", "'ISO ' || iso"),
    ("form_code IS NOT NULL", "form_code", "0.85", "kind"),
    ("tool AND wooden", "'16.29.14'", "0.80", "'модельная оснастка деревянная'"),
    ("tool", "'25.73.60'", "0.80", "'модельная оснастка'"),
    ("tip AND brass", "'24.44.13'", "0.85", "'наконечник латунный'"),
    ("tip", "'25.99.29'", "0.80", "'наконечник'"),
    ("true", "'UNSURE'", "0.20", "'не удалось классифицировать'"),
]
