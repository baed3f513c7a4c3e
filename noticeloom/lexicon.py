"""Rule tables of the notice library. They are parameters: each function takes a ``Lexicon``, by default this one."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values --------------------------------------------------------------------------------------------------

#: Support field: keyword: weight.
FIELD_KEYWORDS = {
    "물류비": {"물류비": 3, "운송": 1, "운임": 2, "특송": 3, "EMS": 3, "해운": 1, "창고보관": 2, "배송": 1},
    "해외전시·박람회": {"박람회": 3, "전시회": 3, "부스": 2, "엑스포": 2, "공동관": 2, "시장개척단": 3},
    "바이어·상담회": {"바이어": 3, "수출상담회": 3, "상담회": 2, "초청": 1, "매칭": 1},
    "통번역": {"통역": 3, "번역": 3, "통번역": 3, "통·번역": 3, "통․번역": 3},
    "인증·규격": {"인증": 2, "규격": 2, "할랄": 3, "FDA": 3, "CE인증": 3, "시험성적": 2},
    "관세·FTA": {"관세": 2, "FTA": 3, "원산지": 3, "환급": 2, "통관": 1},
    "해외거점·지사화": {"지사화": 3, "상설판매장": 3, "해외지사": 3, "거점": 2, "팝업스토어": 3, "유통망 입점": 3},
    "온라인·홍보마케팅": {"온라인": 1, "디지털 마케팅": 3, "홍보물": 2, "카탈로그": 2, "마케팅": 1, "판촉": 1, "홍보": 1},
    "교육·컨설팅": {"교육": 1, "컨설팅": 2, "멘토링": 2, "코칭": 2},
    "금융·보험": {"보험": 2, "보증": 2, "금융": 2, "대출": 3, "이차보전": 3},
}

#: Industries in canonical order; those of manufacturers.
INDUSTRIES = ("농수산", "식품", "화장품(뷰티)", "공예품", "생활용품(소비재)", "의료기기", "기타 공산품")
MANUFACTURING = ("화장품(뷰티)", "공예품", "생활용품(소비재)", "의료기기", "기타 공산품")

#: (pattern, industries, whether it may be used on body text).
INDUSTRY_RULES = (
    ("농수산식품|농수축산|농축수산|농식품|수산식품|수산가공|농산가공|농수산", ("농수산", "식품"), True),
    ("농산물|수산물|농축산|축산물|임산물|화훼|인삼|과일|과채|버섯|해조류?|수산업|수산|농산|김\\s*수출|쌀\\s*수출|농업인|어업인", ("농수산",), True),
    ("식품|K-?푸드|K-?FOOD|\\bFOOD\\b|음료|주류|전통주|장류|김치|가공식품|간편식|HMR|제과|커피|할랄\\s*식품", ("식품",), True),
    ("화장품|코스메|뷰티|BEAUTY|Cosmoprof|코스모프로프", ("화장품(뷰티)",), True),
    ("공예|한지|도자기|옻칠|칠기|문화상품|굿즈", ("공예품",), True),
    ("생활용품|생활소비재|리빙|Lifestyle|라이프스타일|주방용품|유아용품|육아용품|완구|문구|패션|의류|잡화|가구|인테리어|홈데코|신발|반려동물|펫\\s*용품|가전", ("생활용품(소비재)",), True),
    ("소비재", ("식품", "화장품(뷰티)", "생활용품(소비재)", "공예품"), True),
    ("의료기기|의료기|메디칼|메디컬|MEDICA|Expomed|Hospital|헬스케어|바이오헬스|디지털헬스|병원|치과|덴탈|Dental", ("의료기기",), True),
    ("공산품|제조기업|제조업체?|제조사|제조\\s*중소기업", MANUFACTURING, True),
    (
        "산업재|기계|자동차|오토모티브|모빌리티|신소재|전기전자|전자부품|반도체|디스플레이|방산|방위산업|조선|철강|석유화학|"
        "이차전지|배터리|수소|에너지|원전|플랜트|건자재|섬유|봉제|농기계|드론|로봇|ICT|정보통신|소프트웨어|스마트팜\\s*기자재",
        ("기타 공산품",),
        True,
    ),
    (
        "부품|세미콘|로보|자동차전장|해양플랜트|금속|화학|탄소|건설|스마트팜|방송장비|소방|광학|제약|\\bIT\\b|\\bAI\\b|스마트시티|"
        "정보보안|사이버\\s*보안|보안\\s*전시|콘텐츠\\s*(?:산업|기업|아메리카|마켓|쇼케이스)|게임|웹툰|애니메이션|에듀테크|핀테크",
        ("기타 공산품",),
        False,
    ),
)

#: Earlier industry names: today's.
OLD_INDUSTRY = {
    "농산": ("농수산",), "수산": ("농수산",), "식품": ("식품",), "공산품": MANUFACTURING, "기타": ("기타 공산품",), "화장품": ("화장품(뷰티)",), "뷰티": ("화장품(뷰티)",),
    "생활용품": ("생활용품(소비재)",), "소비재": ("생활용품(소비재)",), "공예": ("공예품",), "의료": ("의료기기",), "기타공산품": ("기타 공산품",),
}

#: What a company of an industry may join besides its own.
INDUSTRY_COMPAT = {"농수산": ("식품",)}

#: Province alias: province.
SIDO = {
    "서울": "서울", "부산": "부산", "대구": "대구", "인천": "인천", "광주": "광주", "대전": "대전", "울산": "울산", "세종": "세종", "경기": "경기", "강원": "강원",
    "충북": "충북", "충청북": "충북", "충남": "충남", "충청남": "충남", "전북": "전북", "전라북": "전북", "전남": "전남", "전라남": "전남",
    "경북": "경북", "경상북": "경북", "경남": "경남", "경상남": "경남", "제주": "제주",
}

#: Province: its cities and counties, those with a name of their own.
SIGUN = {
    "경기": "수원 성남 의정부 안양 부천 광명 평택 동두천 안산 고양 과천 구리 남양주 오산 시흥 군포 의왕 하남 용인 파주 이천 안성 김포 화성 양주 포천 여주 연천 가평 양평",
    "강원": "춘천 원주 강릉 동해 태백 속초 삼척 홍천 횡성 영월 평창 정선 철원 화천 양구 인제 양양",
    "충북": "청주 충주 제천 보은 옥천 영동 증평 진천 괴산 음성 단양",
    "충남": "천안 공주 보령 아산 서산 논산 계룡 당진 금산 부여 서천 청양 홍성 예산 태안",
    "전북": "전주 군산 익산 정읍 남원 김제 완주 진안 무주 장수 임실 순창 고창 부안",
    "전남": "목포 여수 순천 나주 광양 담양 곡성 구례 고흥 보성 화순 장흥 강진 해남 영암 무안 함평 영광 장성 완도 진도 신안",
    "경북": "포항 경주 김천 안동 구미 영주 영천 상주 문경 경산 의성 청송 영양 영덕 청도 고령 성주 칠곡 예천 봉화 울진 울릉",
    "경남": "창원 진주 통영 사천 김해 밀양 거제 양산 의령 함안 창녕 남해 하동 산청 함양 거창 합천",
    "제주": "서귀포",
}

COUNTRY_WORDS = ("중동", "미국", "미주", "일본", "중국", "베트남", "동남아", "유럽", "러시아", "인도", "UAE", "사우디", "대만", "홍콩", "태국", "인도네시아", "말레이시아", "호주", "캐나다", "멕시코", "아프리카", "나고야")

#: Country group: words.
COUNTRY_GROUP = {
    "중동": ("중동", "UAE", "사우디", "카타르", "쿠웨이트", "이스라엘", "튀르키예", "터키", "이란", "이라크", "오만", "바레인", "요르단"),
    "동남아": ("동남아", "베트남", "태국", "인도네시아", "말레이시아", "필리핀", "싱가포르", "캄보디아", "미얀마"),
    "미주": ("미주", "미국", "캐나다", "멕시코", "브라질", "칠레"),
    "유럽": ("유럽", "독일", "프랑스", "영국", "네덜란드", "이탈리아", "스페인", "폴란드"),
    "중화권": ("중화권", "중국", "대만", "홍콩"),
    "일본": ("일본", "나고야", "도쿄", "오사카"),
}

#: Document category: pattern of a heading.
DOC_CATEGORIES = (
    ("사업개요", "개요|목적|배경|추진방향|사업\\s*내용"),
    ("신청자격·지원대상", "대상|자격|요건|제외"),
    ("지원내용·규모", "지원\\s*(내용|규모|한도|금액|기준|비율|항목|분야)|지원금|보조금"),
    ("신청방법·접수", "신청|접수|제출\\s*방법|참여\\s*방법|절차"),
    ("제출서류", "제출\\s*서류|구비\\s*서류|서류"),
    ("선정·평가", "선정|평가|심사"),
    ("추진일정", "일정|추진\\s*계획|향후"),
    ("유의사항", "유의|기타|준수|환수|정산"),
    ("문의처", "문의|담당"),
)

#: Topic: keys that name it.
TOPIC_KEYS = {
    "사업명": ("사 업 명", "사업명", "조 사 명", "조사명"),
    "사업목적": ("사업목적", "조사목적"),
    "사업기간": ("사업기간", "사업 추진기간"),
    "조사기간": ("조사기간",),
    "지원대상": ("지원대상", "조사대상", "신청대상"),
    "지원내용": ("지원내용",),
    "지원규모": ("지원규모", "지원한도", "지원비율"),
    "운영조건": ("운영조건", "의무 운영기간", "신규개설 기한"),
    "수탁기관": ("수탁기관",),
    "접수기간": ("접수기간", "제출기간"),
    "제출서류": ("제출서류",),
    "신청방법": ("신청방법",),
    "평가방법": ("평가방법", "방법", "선정"),
}

#: Source by rising priority of republication: the first keeps a notice; id prefix: source.
SOURCE_ORDER = ("jexport", "jbexport", "at", "kotra", "bizinfo")
SOURCE_PREFIX = {"JB-": "jbexport", "AT-": "at", "KOTRA-": "kotra", "BIZ-": "bizinfo"}

#: (pattern, replacement) of identifying numbers, in order.
MASKS = (
    ("\\b\\d{3}-\\d{2}-\\d{5}\\b", "***-**-*****"),
    ("\\b\\d{6}-\\d{7}\\b", "******-*******"),
    ("\\b01[016789]-?\\d{3,4}-?\\d{4}\\b", "010-****-****"),
    ("[\\w.+-]+@[\\w-]+\\.[\\w.]+", "***@***"),
)
EMAIL = "[\\w.+-]+@[\\w-]+\\.[\\w.]+"
PHONE = "0\\d{1,2}-\\d{3,4}-\\d{4}"

#: What a title says besides its subject.
TITLE_NOISE = "참가기업|참여기업|참가업체|참여업체|수요기업|대상기업|모집\\s*공고|모집|공고|안내|신청|지원\\s*사업|사업|재공고|추가|연장|수시|접수"
EVENTS = "세미나|설명회|포럼|웨비나|박람회|전시회|엑스포|EXPO|로드쇼|컨퍼런스|콘퍼런스|페어|상담회|사절단|센터"

OPEN, UPCOMING, CLOSED = "접수중", "접수예정", "접수마감"
NATIONWIDE, DISTRIBUTOR, SME = "전국", "해외 유통매장 운영사", "중소기업"
SECTION_TARGET, SECTION_OVERVIEW = "지원대상", "사업개요"

#: Alert threshold, and duplicate thresholds: body, title, (title, body), title beside a shared attachment name.
ALERT_MIN = 70
DOC_SIM, TITLE_SIM, TITLE_DOC_SIM, STEM_TITLE_SIM = 0.55, 0.86, (0.6, 0.3), 0.5


@dataclass(frozen=True)
class Lexicon:
    """The rule tables that text extraction and matching read."""

    fields: dict = field(default_factory=lambda: FIELD_KEYWORDS)
    industries: tuple = INDUSTRIES
    industry_rules: tuple = INDUSTRY_RULES
    old_industry: dict = field(default_factory=lambda: OLD_INDUSTRY)
    compat: dict = field(default_factory=lambda: INDUSTRY_COMPAT)
    sido: dict = field(default_factory=lambda: SIDO)
    sigun: dict = field(default_factory=lambda: SIGUN)
    countries: tuple = COUNTRY_WORDS
    country_groups: dict = field(default_factory=lambda: COUNTRY_GROUP)
    doc_categories: tuple = DOC_CATEGORIES
    topics: dict = field(default_factory=lambda: TOPIC_KEYS)

    @property
    def city_province(self) -> dict:
        return {city: province for province, names in self.sigun.items() for city in names.split()}


KOREAN = Lexicon()
