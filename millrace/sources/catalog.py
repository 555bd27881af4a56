"""The catalogue of monitored boards and the score floors: the library's dimension tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import or_else
from millrace.sources.specs import LISTS

#: Group, target id, name, address, list layout, detail layout, parameters, why disabled.
TARGETS = """
news | 국가유산청_공지사항 | 국가유산청 공지사항 | https://www.khs.go.kr/multiBbz/selectMultiBbzList.do?bbzId=newpublic&mn=NS_01_01 | khs | khs |  |
news | 국가유산청_보도설명 | 국가유산청 보도/설명 | https://www.khs.go.kr/newsBbz/selectNewsBbzList.do?sectionId=all_sec_1&mn=NS_01_02 | khs | khs |  |
news | 국가유산청_사진뉴스 | 국가유산청 사진뉴스 | https://www.khs.go.kr/cop/bbs/selectBoardList.do?bbsId=BBSMSTR_1002&mn=NS_01_03 | khs_gallery | khs |  |
news | 국가유산청_입법예고 | 국가유산청 입법예고 | https://www.khs.go.kr/lawBbz/selectLawBbzList.do?mn=NS_03_01_01 | khs_law | khs |  |
news | 국가유산청_발굴조사_현황공개 | 국가유산청 발굴조사 현황공개 | https://www.e-minwon.go.kr/ge/ee/getListEcexmPrmsnAply.do | excavation_status | excavation_status |  | low value
news | 국가유산청_발굴조사_보고서 | 국가유산청 발굴조사 보고서 | https://www.e-minwon.go.kr/ge/ee/getListEcexmRptp.do | excavation_report | excavation_report |  |
news | 국가유산청_발굴조사_현장공개 | 국가유산청 발굴조사 현장공개 | https://www.e-minwon.go.kr/ge/ee/getListLinkGrndsRls.do | excavation_site | excavation_site |  |
news | 국립문화유산연구원_공지사항 | 국립문화유산연구원 공지사항 | https://www.nrich.go.kr/kor/boardList.do?menuIdx=282&bbscd=32 | nrich_notice | nrich_notice |  |
news | 국립문화유산연구원_주요행사 | 국립문화유산연구원 주요행사 | https://www.nrich.go.kr/kor/majorList.do?menuIdx=286 | nrich_event | nrich_event |  |
news | 국립문화유산연구원_학술지_헤리티지 | 국립문화유산연구원 헤리티지:역사와 과학 학술지 | https://www.nrich.go.kr/kor/subscriptionDataUsrList.do?menuIdx=1651&gubun=J | nrich_journal | nrich_journal |  |
news | 국립문화유산연구원_학술지_보존과학연구 | 국립문화유산연구원 보존과학연구 학술지 | https://www.nrich.go.kr/kor/subscriptionDataUsrList.do?menuIdx=2065&gubun=K | nrich_journal | nrich_journal |  |
news | 국가유산지식이음_공지사항 | 국가유산 지식이음 공지사항 | https://portal.nrich.go.kr/kor/boardList.do?menuIdx=1058&bbscd=9 | nrich_portal | nrich_portal |  |
news | 국립고궁박물관_공지사항 | 국립고궁박물관 공지사항 | https://www.gogung.go.kr/gogung/bbs/BMSR00022/list.do?gubunCd=B22_001&menuNo=800088 | gogung | gogung |  |
news | 국가유산진흥원_공지사항 | 국가유산진흥원 공지사항 | https://www.kh.or.kr/brd/board/644/L/SITES/100/menu/371 | heritage_agency | heritage_agency |  |
news | 국가유산진흥원_보도자료 | 국가유산진흥원 보도자료 | https://www.kh.or.kr/brd/board/715/L/menu/373 | heritage_agency | heritage_agency |  |
news | 국가유산진흥원_매장유산국비발굴단_공지사항 | 국가유산진흥원 매장유산국비발굴단 공지사항 | https://www.kh.or.kr/brd/board/644/L/SITES/201/menu/506 | heritage_agency | heritage_agency |  |
news | 국가유산진흥원_매장유산국비발굴단_현장설명회 | 국가유산진흥원 매장유산국비발굴단 현장설명회 | https://www.kh.or.kr/brd/board/631/L/menu/504 | heritage_agency | heritage_agency |  |
news | 한국문화유산협회_공지사항 | 한국문화유산협회 공지사항 | https://www.kaah.kr/notice | kaah | kaah |  |
news | 한국문화유산협회_협회소식 | 한국문화유산협회 협회소식 | https://www.kaah.kr/news | kaah | kaah |  |
news | 한국문화유산협회_보도자료 | 한국문화유산협회 보도자료 | https://www.kaah.kr/mass | kaah | kaah |  |
news | 한국문화유산협회_회원기관소식 | 한국문화유산협회 회원기관소식 | https://www.kaah.kr/assnews | kaah | kaah |  |
news | 한국문화유산협회_유관기관소식 | 한국문화유산협회 유관기관소식 | https://www.kaah.kr/ralnews | kaah | kaah |  |
news | 한국문화유산협회_발굴현장공개 | 한국문화유산협회 발굴현장공개 | https://www.kaah.kr/placeopen | kaah_place | kaah_place |  |
news | 한국고고학회_공지사항 | 한국고고학회 공지사항 | https://www.kras.or.kr/?r=kras&m=bbs&bid=notice | kras | kras |  |
news | 한국고고학회_학술대회및행사 | 한국고고학회 학술대회 및 행사 | https://www.kras.or.kr/?r=kras&m=bbs&bid=sympo | kras | kras |  |
news | 한국고고학회_신간안내_단행본 | 한국고고학회 신간안내 - 단행본 | https://www.kras.or.kr/?c=61/101/105 | kras | kras |  |
news | 한국고고학회_현장소식 | 한국고고학회 현장소식 | https://www.kras.or.kr/?c=61/73 | kras | kras |  |
news | 중부고고학회_공지사항 | 중부고고학회 공지사항 | https://www.jbgogo.or.kr/bbs/notice | jbgogo | jbgogo |  |
news | 중부고고학회_학계소식 | 중부고고학회 학계소식 | https://www.jbgogo.or.kr/bbs/news | jbgogo | jbgogo |  |
news | 중부고고학회_발굴현장소식 | 중부고고학회 발굴현장소식 | https://www.jbgogo.or.kr/bbs/spotnews | jbgogo | jbgogo |  |
news | 호서고고학회_공지사항 | 호서고고학회 공지사항 | http://www.hsas.or.kr/flow/?ref=board/board.emt&menu_table=m2_00&bbs_table=notice&menu_idx=010000 | hsas | hsas |  |
news | 호서고고학회_학회소식 | 호서고고학회 학회소식 | http://www.hsas.or.kr/flow/?ref=board/board.emt&menu_table=m2_00&bbs_table=m2_01&menu_idx=020000 | hsas | hsas |  |
news | 영남고고학회_공지사항 | 영남고고학회 공지사항 | http://www.yngogo.or.kr/subList/32000001120 | yngogo | yngogo | menu=32000001120 bbs=32000001157 contents=32000001711 |
news | 영남고고학회_학계소식 | 영남고고학회 학계소식 | http://www.yngogo.or.kr/subList/32000001133 | yngogo | yngogo | menu=32000001133 bbs=32000001161 contents=32000001715 |
news | 영남고고학회_현장소식 | 영남고고학회 현장소식 | http://www.yngogo.or.kr/subList/32000001135 | yngogo | yngogo | menu=32000001135 bbs=32000001163 contents=32000001717 |
news | 국립중앙박물관_알림 | 국립중앙박물관 알림 | https://www.museum.go.kr/MUSEUM/contents/M0701010000.do?catCustomType=united&catId=128 | museum | museum | prefix=/MUSEUM/contents/M0701010000.do |
news | 국립중앙박물관_고시공고 | 국립중앙박물관 고시/공고 | https://www.museum.go.kr/MUSEUM/contents/M0701020000.do | museum | museum | prefix=/MUSEUM/contents/M0701020000.do |
news | 국립중앙박물관_보도자료 | 국립중앙박물관 보도 자료 | https://www.museum.go.kr/MUSEUM/contents/M0701040000.do?catCustomType=post&catId=93 | museum_press | museum |  |
news | 국립전주박물관_새소식 | 국립전주박물관 새소식 | https://jeonju.museum.go.kr/board.es?mid=a10105010000&bid=0001 | jeonju_museum | jeonju_museum |  |
news | 국립전주박물관_보도자료 | 국립전주박물관 보도자료 | https://jeonju.museum.go.kr/board.es?mid=a10105050000&bid=0004 | jeonju_museum | jeonju_museum |  |
news | 국립부여박물관_공지사항 | 국립부여박물관 공지사항 | https://buyeo.museum.go.kr/bbs/list.do?key=2301250005 | buyeo_museum | buyeo_museum | list=2301250005 |
news | 국립부여박물관_보도자료 | 국립부여박물관 보도자료 | https://buyeo.museum.go.kr/bbs/list.do?key=2302150024 | buyeo_museum | buyeo_museum | list=2302150024 |
news | 국립진주박물관_새소식 | 국립진주박물관 새소식 | https://jinju.museum.go.kr/kor/html/sub06/0601.html | jinju_museum | jinju_museum |  |
news | 국립경주박물관_새소식 | 국립경주박물관 새소식 | https://gyeongju.museum.go.kr/kor/html/sub07/0701.html | gyeongju_museum | gyeongju_museum | prefix=/kor/html/sub07/0701.html | robots.txt
news | 국립경주박물관_고시공고 | 국립경주박물관 고시/공고 | https://gyeongju.museum.go.kr/kor/html/sub07/0703.html | gyeongju_museum_notice | gyeongju_museum |  | robots.txt
news | 국립경주박물관_보도자료 | 국립경주박물관 보도자료 | https://gyeongju.museum.go.kr/kor/html/sub07/0705.html | gyeongju_museum | gyeongju_museum | prefix=/kor/html/sub07/0705.html | robots.txt
news | 국립청주박물관_새소식 | 국립청주박물관 새소식 | https://cheongju.museum.go.kr/www/selectBbsNttList.do?bbsNo=1&key=482&nbar=s | cheongju_museum | cheongju_museum |  | robots.txt
news | 국립청주박물관_언론보도자료 | 국립청주박물관 언론보도자료 | https://cheongju.museum.go.kr/www/selectBbsNttList.do?bbsNo=20&key=31&nbar=s | cheongju_museum | cheongju_museum |  | robots.txt
news | 국립김해박물관_새소식 | 국립김해박물관 새소식 | https://gimhae.museum.go.kr/kr/html/sub04/0401.html | gimhae_museum | gimhae_museum | prefix=/kr/html/sub04/0401.html | robots.txt
news | 국립김해박물관_보도자료 | 국립김해박물관 언론보도자료 | https://gimhae.museum.go.kr/kr/html/sub04/0402.html | gimhae_museum | gimhae_museum | prefix=/kr/html/sub04/0402.html | robots.txt
news | 국립제주박물관_새소식 | 국립제주박물관 새소식 | https://jeju.museum.go.kr/_prog/_board/?code=sub02_0201&site_dvs_cd=kr&menu_dvs_cd=050101&ntt_tag=1 | jeju_museum | jeju_museum |  | robots.txt
news | 국립익산박물관_공지사항 | 국립익산박물관 공지사항 | https://iksan.museum.go.kr/kor/html/sub05/0501.html | iksan_museum | iksan_museum |  | robots.txt
business | 국가유산청_입찰정보 | 국가유산청 입찰정보 | https://www.khs.go.kr/tenderBbz/selectTenderBbzList.do?mn=NS_01_05 | khs | khs |  |
business | 국가유산진흥원_입찰정보 | 국가유산진흥원 입찰정보 | https://www.kh.or.kr/brd/board/717/L/menu/375 | heritage_agency | heritage_agency |  |
business | 한국문화유산협회_사업공고 | 한국문화유산협회 사업공고 | https://www.kaah.kr/bussopen | kaah | kaah |  |
business | 한국문화유산협회_입찰공고 | 한국문화유산협회 입찰공고 | https://www.kaah.kr/ipcopen | kaah | kaah |  |
employment | 국가유산청_시험채용 | 국가유산청 시험/채용 | https://www.khs.go.kr/multiBbz/selectMultiBbzList.do?bbzId=newexam&mn=NS_01_06 | khs | khs |  |
employment | 국가유산진흥원_인재채용 | 국가유산진흥원 인재채용 | https://www.kh.or.kr/brd/board/721/L/CATEGORY/719/menu/377 | heritage_agency | heritage_agency |  |
employment | 한국문화유산협회_채용공고 | 한국문화유산협회 채용공고 | https://www.kaah.kr/reqopen | kaah | kaah |  |
employment | 영남고고학회_채용공고 | 영남고고학회 채용공고 | http://www.yngogo.or.kr/subList/32000001136 | yngogo | yngogo | menu=32000001136 bbs=32000001164 contents=32000001718 |
employment | 국립중앙박물관_채용안내 | 국립중앙박물관 채용 안내 | https://www.museum.go.kr/MUSEUM/contents/M0701030000.do?catCustomType=post&catId=54&recruitYn=Y | museum_recruit | museum |  |
employment | 국립전주박물관_채용 | 국립전주박물관 채용 | https://jeonju.museum.go.kr/board.es?mid=a10105020000&bid=0002 | jeonju_museum_recruit | jeonju_museum |  |
employment | 국립부여박물관_채용공고 | 국립부여박물관 채용공고 | https://buyeo.museum.go.kr/bbs/list.do?key=2301270001 | buyeo_museum | buyeo_museum | list=2301270001 |
employment | 국립경주박물관_채용안내 | 국립경주박물관 채용안내 | https://gyeongju.museum.go.kr/kor/html/sub07/0704.html | gyeongju_museum | gyeongju_museum | prefix=/kor/html/sub07/0704.html | robots.txt
employment | 국립청주박물관_채용및공고 | 국립청주박물관 채용 및 공고 | https://cheongju.museum.go.kr/www/selectBbsNttList.do?bbsNo=29&key=476&nbar=s | cheongju_museum | cheongju_museum |  | robots.txt
employment | 국립제주박물관_채용정보 | 국립제주박물관 채용정보 | https://jeju.museum.go.kr/_prog/_board/?code=sub02_0201&site_dvs_cd=kr&menu_dvs_cd=050102&ntt_tag=2 | jeju_museum | jeju_museum |  | robots.txt
"""

GROUPS = {"news": "News", "business": "Business", "employment": "Employment"}

#: Boards whose articles score at least so much. Entries may repeat.
SCORE_FLOORS = [
    ("https://www.kras.or.kr/?r=kras&m=bbs&bid=notice", 6),
    ("https://www.kras.or.kr/?r=kras&m=bbs&bid=sympo", 6),
    ("https://www.kras.or.kr/?c=61/101/105", 6),
    ("https://www.kaah.kr/notice", 6),
    ("https://www.kaah.kr/news", 6),
    ("https://www.kaah.kr/mass", 6),
    ("https://www.kaah.kr/assnews", 6),
    ("https://www.kaah.kr/ralnews", 6),
    ("https://www.kaah.kr/notice", 6),
    ("https://www.kaah.kr/placeopen", 6),
    ("https://www.kaah.kr/bussopen", 6),
    ("https://www.kaah.kr/ipcopen", 6),
    ("https://www.e-minwon.go.kr/ge/ee/getListEcexmPrmsnAply.do", 2),
    ("https://www.e-minwon.go.kr/ge/ee/getListEcexmRptp.do", 2),
    ("https://www.e-minwon.go.kr/ge/ee/getListLinkGrndsRls.do", 2),
]

TARGET_DDL = """group_id string, group_name string, target_id string, target_name string, url string, list_spec string,
detail_spec string, params map<string,string>, enabled boolean, disabled_reason string, pos int"""


def target_rows() -> list[tuple]:
    rows = []
    for pos, line in enumerate(TARGETS.strip().split("\n")):
        group, target, name, url, list_spec, detail_spec, params, *why = (x.strip() for x in (line + " |").split(" |")[:8])
        values = dict(p.split("=", 1) for p in params.split())
        reason = why[0] if why and why[0] else None
        rows.append((group, GROUPS[group], target, name, url, list_spec, detail_spec, values, reason is None, reason, pos))
    return rows


def targets(spark: SparkSession, with_disabled: bool = False) -> DataFrame:
    """A row per board; the enabled ones unless told otherwise."""
    rows = spark.createDataFrame(target_rows(), TARGET_DDL)
    return rows if with_disabled else rows.where("enabled")


def groups(spark: SparkSession) -> DataFrame:
    """A row per group with its enabled boards nested, as a listing shows them."""
    own = F.struct("pos", F.col("target_id").alias("id"), F.col("target_name").alias("name"), "url")
    nested = targets(spark).groupBy("group_id", "group_name").agg(F.sort_array(F.collect_list(own)).alias("t"), F.min("pos").alias("pos"))
    listed = F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"), t["url"].alias("url")))
    return nested.select(F.col("group_id").alias("id"), F.col("group_name").alias("name"), listed.alias("targets"), "pos").orderBy("pos").drop("pos")


def score_floors(spark: SparkSession) -> DataFrame:
    """One floor per address: the highest of its entries, so that joins don't multiply rows."""
    rows = spark.createDataFrame(SCORE_FLOORS, "target_url string, min_score int")
    return rows.groupBy("target_url").agg(F.max("min_score").alias("min_score"))


class TargetNotFound(LookupError):
    """No board of that group and id."""


def find_target(spark: SparkSession, group_id: str, target_id: str, custom_url: str | None = None) -> DataFrame:
    """One board's row, its address replaced by ``custom_url`` if that isn't empty."""
    own = targets(spark).where((F.col("group_id") == group_id) & (F.col("target_id") == target_id))
    if own.isEmpty():
        raise TargetNotFound(f"{group_id}/{target_id}")
    return own.withColumn("url", F.lit(custom_url)) if custom_url else own


def answered(asked: DataFrame, needs_detail: bool = False) -> DataFrame:
    """``asked (group_id, target_id, custom_url, detail_url)`` with each request's board and address, or what is wrong with it.

    Adds url, list_spec, detail_spec, status and error: 404 for a board that isn't there or isn't enabled, 400 for a missing detail
    address where one is needed, else 200. An address that is given stands in for the board's unless it is empty.
    """
    own = F.broadcast(targets(asked.sparkSession).select("group_id", "target_id", F.col("url").alias("own"), "list_spec", "detail_spec"))  # a few dozen rows
    rows = asked.join(own, ["group_id", "target_id"], "left")
    status = F.when(F.col("own").isNull(), 404).when(F.lit(needs_detail) & (or_else(F.col("detail_url"), F.lit("")) == ""), 400).otherwise(200)
    error = F.when(status == 404, F.concat(F.lit("no such board: "), F.concat_ws("/", "group_id", "target_id"))).when(status == 400, "the address of the detail page is missing")
    url = F.when(status == 200, or_else(F.col("custom_url"), F.col("own")))
    return rows.select(*asked.columns, url.alias("url"), "list_spec", "detail_spec", status.alias("status"), error.alias("error"))


LIST_SPEC_DDL = """list_spec string, id_rule string, id_arg string, url_rule string, origin string, url_arg string, url_to string,
date_rule string, date_prefix string, drop_text string, widen_tilde boolean, need_href boolean, need_id boolean, clean boolean"""


def list_specs(spark: SparkSession) -> DataFrame:
    """What of the list layouts is applied in columns, as a table."""
    rows = []
    for s in LISTS:
        rule, origin, *rest = s.url
        arg, to = (*rest, "", "")[:2]
        rows.append((s.name, *s.ident, rule, origin, arg, to, s.dates, s.date_prefix, s.drop_text, s.widen_tilde, s.need_href, s.need_id, s.clean))
    names = [c.split()[0] for c in LIST_SPEC_DDL.split(",")]
    return spark.createDataFrame(pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))), LIST_SPEC_DDL)  # rows of the JVM, for which no task starts Python
