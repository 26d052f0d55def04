"""Word lists, patterns, weights and limits that results depend on."""

# --- Documents and categories ---
OTHER = "其它"
CATEGORY_KEYWORDS = {
    "发票": ("发票", "增值税专用发票", "增值税普通发票", "价税合计", "纳税人识别号", "开票日期"),
    "物流凭证": ("运单", "提货单", "发货单", "承运人", "收货人", "快递单号", "物流"),
}
CONTRACT_TOKENS = ("合同", "协议")
CONTRACT_EXTENSIONS = (".pdf", ".doc", ".docx", ".docm", ".rtf", ".wps")
TITLE_PREFIXES = ("doc_title:", "header:", "paragraph_title:", "figure_title:", "title:")
TITLE_LABEL = r"^[\s　]*(合同|协议)?\s*(编号|号码|名称|金额|价款|期限|有效期|总额|总金额|日期|类型|状态)\s*[:：]"
EMPTY_LABEL = r"^[\s　]*[一-龥A-Za-z0-9（）()、·\-_/]{0,16}[:：][\s　]*$"
INPUT_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "docx", "xlsx", "doc", "xls")
OCR_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")

# --- Table headers ---
HEADER_RULES = (
    ("tax_id", ("纳税人识别号", "纳税识别号", "税号", "统一社会信用代码")),
    ("id_card", ("身份证", "证件号", "证件号码")),
    ("bank_name", ("开户行", "开户银行", "银行名称")),
    ("bank_account", ("银行账号", "对公账号", "账号", "帐号", "账户", "卡号", "银行卡")),
    ("phone", ("联系电话", "手机号", "手机号码", "联系方式", "电话")),
    ("party", ("员工", "姓名", "经办人", "经办", "负责人", "联系人", "法人", "法定代表人", "申请人", "签收人", "签发人", "审核人", "批准人", "制表人", "复核人", "经办人员", "签名", "签字", "签署人")),
    ("company", ("甲方", "乙方", "单位全称", "单位名称", "收款单位", "付款单位", "开票单位", "供货单位", "购货单位", "公司", "客户", "供应商", "购方", "销方", "抬头")),
    ("date", ("日期", "签订日", "开票日", "付款日", "到期日")),
)
AMBIGUOUS_HEADERS = ("单位", "公司", "名称", "抬头", "编号", "金额", "备注")
COMPANY_HEADER_TAIL = r"(单位|公司|企业|集团)$"
MAX_VALUE_LENGTH = {"company": 40, "party": 20, "bank_name": 60, "date": 12}
HEADER_SCAN = 4

# --- Values ---
ID_CARD = r"^[0-9]{17}[0-9Xx]$"
ACCOUNT = r"^[0-9]{12,19}$"
TAX_ID = r"^[0-9A-Z]{15,20}$"
DATE = r"^[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?$"
PHONE = r"^(1[3-9][0-9]{9}|0[0-9]{9,11})$"
CJK = r"[一-龥]"
CODE = r"\[(?:本公司·)?[A-Z]{2}[0-9]{4,}\]|(?<![A-Za-z])[A-Z]{2}[0-9]{4,}(?![0-9])"
PREFIXES = {"company": "CO", "party": "PT", "date": "DT", "id_card": "ID", "bank_card": "BC", "tax_id": "TX", "bank_name": "BK", "bank_account": "BA", "project": "PJ", "phone": "PH"}
SECRET = ("id_card", "bank_card", "tax_id", "bank_name", "bank_account", "project", "phone")
FAIL_CLOSED = "【脱敏失败·已屏蔽】"

COMPANY_SUFFIXES = (
    "有限公司", "有限责任公司", "股份有限公司", "集团有限公司", "集团", "公司", "事务所", "会计师事务所", "律师事务所", "研究院", "设计院", "学院", "大学",
    "研究院有限公司", "厂", "商店", "商行", "门市部", "合作社", "工作室", "人民政府", "管理局", "管理委员会", "委员会", "中心", "事业部", "分公司",
    "办事处", "分行", "支行", "营业部", "分理处", "储蓄所", "税务局", "供电局", "自来水公司", "医院", "学校", "幼儿园", "银行",
)
UNITS = (
    "株", "棵", "枝", "盆", "袋", "包", "箱", "件", "套", "个", "只", "条", "块", "张", "台", "辆", "吨", "公斤", "千克", "克", "斤", "米", "厘米", "毫米",
    "平方米", "立方米", "公里", "升", "毫升", "度", "次", "人", "份", "项", "批", "元", "万元", "天", "月", "年", "小时", "工日", "台班", "杯", "桶", "卷",
)
NOISE = ("¥", "￥", "：", ":", "|", "｜", "，", ",", "。", "；", ";", "（盖章", "（公章", "（签字", "签字", "盖章", "以下", "以下简称")
NOISE_HEADS = ("已付", "已收", "大写", "本次", "备注", "说明", "注：")
LABELS = (
    "单位全称", "单位名称", "购方", "销方", "甲方", "乙方", "合同名称", "合同编号", "合同金额", "项目名称", "项目付款进度", "申请拨款金额", "付款方式", "开户行",
    "开户银行", "银行账号", "纳税人识别号", "统一社会信用代码", "申请人", "申请日期", "管理处核实意见", "备注", "序号", "品种", "规格", "数量", "单价", "总额", "合计",
    "价税合计", "金额", "税额", "开票日期", "开票人", "收款人", "复核人", "制表人", "审核人", "批准人", "经办人", "法定代表人", "地址", "电话", "联系方式", "养护期",
    "服务期", "日期", "期间", "季度", "月份", "下载次数", "企业名称", "公司地址", "单位", "名称", "编号", "类型", "状态", "说明",
    "时间", "地点", "会议时间", "会议地点", "主持人", "参会人员", "与会人员", "列席部门", "投标单位", "谈判小组", "签名",
)
DATE_FRAGMENT = r"([0-9]{1,4}\s*年|[0-9]{1,2}\s*月|[0-9]{1,2}\s*日|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2})"
MONEY = r"[¥￥]?\s*[0-9][0-9,]*\.?[0-9]*\s*(元|万元)"
PERSON = r"^[一-龥·]{2,4}$"
SURNAMES = (
    "张王李赵刘陈杨黄周吴徐孙马朱胡郭林何高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金"
    "石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
)
BANKS = (
    "中国人民银行", "中国工商银行", "中国农业银行", "中国建设银行", "中国银行", "交通银行", "招商银行", "中信银行", "光大银行", "华夏银行", "民生银行",
    "兴业银行", "浦发银行", "上海浦东发展银行", "广发银行", "平安银行", "中国邮政储蓄银行", "邮储银行", "北京银行", "上海银行", "江苏银行",
    "南京银行", "宁波银行", "杭州银行", "农村商业银行", "农商银行", "村镇银行", "城市商业银行", "农村信用合作社", "信用社",
)
BANK_LABEL_TAILS = ("名称", "账号", "帐号", "账户", "卡号", "开户行", "开户银行", "开户机构", "银行名称", "开户网点", "联行号", "行号", "备注", "说明")
BANK_TAIL = r"(银行|分行|支行|信用社|储蓄所|营业部|分理处|办事处)$"

# --- Layout ---
SIGNATURE_STRONG = r"(签字|盖章|公章|签章|法定代表人)"
SIGNATURE_WEAK = r"(日期|年\s*月\s*日)"
DATE_VALUE = r"^[0-9]{2,4}\s*[-/年.]\s*[0-9]{1,2}\s*[-/月.]\s*[0-9]{1,2}\s*日?$"
TITLE_PUNCTUATION = ("：", ":", "；", ";", "，", ",")
NOTE_HEADS = ("★", "注", "说明", "备注", "附")
KV_WEIGHTS = {"hit": 0.35, "pair_row": 0.25, "label_col": 0.2, "pair": 0.2}

# --- Facts, segments and chunks ---
KV_MAX_LABEL, KV_MAX_VALUE = 12, 300
KV_LINE = r"^\s*([^：:\n]{1,12})[：:]\s*(\S[^\n]{0,299}?)\s*$"
BLOCK_PREFIX = r"^[a-z][a-z_]{1,24}:"
SEGMENT_MAX, SUMMARY_MAX = 2000, 50
SENTENCE_END = "。！？；!?;"
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_FLOAT = 700, 100, 20
CHUNK_LABELS = ("text", "header", "doc_title", "paragraph_title", "number", "table", "seal")
CHUNK_BREAKS = " \t，,。；;：:"

# --- Graph ---
PROJECT_HEADERS = ("项目名称", "项目", "工程名称")
NUMBER_HEADERS = ("合同编号", "发票号码", "发票号", "付款单号", "运单号", "单号", "编号")
AMOUNT_HEADERS = ("金额", "价税合计", "合计", "合同金额", "付款金额", "开票金额", "总额")
TYPE_PAIRS = (("合同", "发票"), ("合同", "物流凭证"), ("合同", "付款凭证"))
#: relation: (groups that must each have a kind, boosts by kind)
RELATIONS = {
    "contract_to_invoice": ((("project", "counterparty"), ("amount", "tax", "doc_no")), {"amount": 0.20, "project": 0.15, "counterparty": 0.10, "tax": 0.10, "doc_no": 0.15}),
    "payment_for_contract": ((("amount",), ("project", "counterparty", "doc_no")), {"amount": 0.25, "doc_no": 0.15, "project": 0.10, "counterparty": 0.10}),
    "contract_to_logistics": ((("doc_no", "project"),), {"doc_no": 0.25, "project": 0.15, "counterparty": 0.10}),
    "same_project": ((("project",),), {"project": 0.30, "counterparty": 0.10}),
    "counterparty_shared": ((("counterparty",),), {"counterparty": 0.25, "amount": 0.10}),
    "amount_consistent": ((("amount",),), {"amount": 0.30, "project": 0.10, "counterparty": 0.10}),
    "table_row_matches_doc": ((("amount", "tax", "doc_no", "counterparty"),), {"amount": 0.20, "tax": 0.20, "doc_no": 0.20, "counterparty": 0.10, "project": 0.10}),
}
BASE_CONFIDENCE, GROUP_CONFIDENCE, MAX_CONFIDENCE = 0.35, 0.25, 0.95
HYPOTHESIS_WEIGHT, MAX_DEPTH, MAX_PATHS, MAX_CHAINS = 0.7, 3, 400, 6
ANCHOR_CONFIDENCE = {"code": 1.0, "doc_no": 1.0, "project": 0.95, "type": 0.8, "amount": 0.6, "field": 0.8, "doc_name": 0.75}

# --- Questions ---
QUESTION_CODE = r"\[(?:本公司·)?[A-Z]{2}[0-9]{4,}\]|(?<![A-Za-z])(?:CO|PT|PJ|TX|BK|BA)[0-9]{4,}(?![0-9])"
QUESTION_DOC_NO = r"(?<![A-Za-z0-9])([A-Z]{2,}[A-Z0-9]*(?:[-_][A-Z0-9]+)+)(?![A-Za-z0-9])"
QUESTION_AMOUNT = r"(?<![0-9.])([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?|[0-9]+\.[0-9]{2})(?![0-9])"
TYPE_KEYWORDS = {"合同": "合同", "发票": "发票", "物流": "物流凭证", "运单": "物流凭证", "付款": "付款", "收款": "付款", "凭证": "付款"}
RELATION_KEYWORDS = {
    "contract_to_invoice": ("发票", "开票", "专票", "普票", "价税合计", "税额"),
    "payment_for_contract": ("付款", "收款", "回款", "资金", "转账", "支付", "结算"),
    "contract_to_logistics": ("物流", "运单", "发货", "提货", "运输", "快递", "签收"),
    "same_project": ("项目", "工程", "同一项目"),
    "counterparty_shared": ("对手方", "对方公司", "同一家", "往来单位"),
    "amount_consistent": ("金额", "对账", "一致", "核对"),
    "table_row_matches_doc": ("汇总表", "台账", "明细表", "表格", "表里", "这一行", "那一行"),
}
DEFAULT_RELATIONS = ("contract_to_invoice", "payment_for_contract", "contract_to_logistics", "table_row_matches_doc")
REVERSE_HINTS = ("哪份合同", "哪一份合同", "对应哪", "来源", "上游", "上游合同", "是谁的")
FIELD_WORDS = (
    "申请拨款金额", "合同金额", "合同总额", "含税金额", "不含税金额", "总额", "合计金额", "本次支付", "付款金额", "订单金额", "扣款金额", "罚款", "罚单", "税率", "开票日期",
    "申请日期", "付款方式", "开户行", "开户银行", "银行账号", "账号", "纳税人识别号", "统一社会信用代码", "采购订单编号", "合同编号", "申请人",
)
FIELD_ALIASES = {
    "合计金额": ("总额", "合计", "合计金额", "金额"),
    "金额": ("总额", "合计", "申请拨款金额", "合同金额", "合同总额", "含税金额", "不含税金额", "付款金额", "订单金额", "扣款金额", "罚款"),
    "本次支付": ("本次支付", "付款金额", "项目付款进度"),
    "扣款": ("扣款金额", "罚款", "罚单", "考核扣款", "考核罚款"),
    "合计扣款": ("扣款金额", "罚款", "罚单"),
}
CLASS_HINTS = {
    "合同": ("合同", "协议"), "开票资料": ("发票", "开票信息"), "发票": ("发票",), "扣款资料": ("扣款通知", "扣款", "罚款", "违约金"),
    "付款资料": ("付款申请", "付款", "结算"), "结算资料": ("结算", "对账"), "物流签收": ("物流", "签收", "送货"), "台账": ("台账",),
}
CARD_WEIGHTS = {"code": 6.0, "amount": 4.0, "period": 5.0, "category": 3.0, "gram": 0.5, "gram_char": 0.25}
CARD_GRAMS = (6, 4, 3, 2)
CARD_STOP = ("是多少", "有多少", "几份", "哪些", "相关", "的单据", "是多少元", "合计")
COUNT_WORDS = r"(多少|几|共|合计|总数|总计|一共|数量)"
DOC_WORDS = r"(文件|文档|资料|份|张)"
EDGE_WORDS = r"(边|关系|节点|证据链)"
FACT_WORDS = r"(事实|字段值|段落|条目)"
LIST_WORDS = r"(哪些|哪几|列出|清单|都有什么|有什么|列表)"
OVERVIEW_WORDS = r"(概览|总览|总体情况|仓库(状态|里有什么)|库里有什么|情况怎么样)"
ANALYTIC_WORDS = r"(为什么|为何|是否|是不是|能否|能不能|如何|怎么|怎样|哪些可能|还有什么可能|区别|原因|依据|风险|建议|应该|等于|一致|合理|会影响|意味着)"
UNSUPPORTED = (
    r"(上月|本月|上个月|这个月|去年|今年|上季度|本季度|上周|本周|最近|最新|今日|今天|超过|大于|小于|不低于|不超过|至少|至多|多于|少于|等于|不等于|"
    r"未[入账开票收付]|没[有入账开票收付]|已[入账开票收付]|待[入账开票收付]|重复|唯一|去重|最大|最小|平均|占比|比例|差异|不一致|对不上|缺失|异常|"
    r"扫描|类型|分别|各自|趋势|对比|挂账|作废|重开|红冲)"
)
VOCABULARY = (
    "当前仓库", "当前库", "本机", "数据库", "仓库", "库里", "库内", "库中", "系统里", "这里", "一共", "总共", "总共有", "共有", "合计", "总计", "数量", "总数", "数目", "多少",
    "几个", "几份", "几条", "几", "多少份", "多少条", "多少张", "多少种", "数", "文件", "文档", "资料", "单据", "记录", "条目", "份", "张", "条", "个", "种",
    "合同", "协议", "发票", "开票", "开票信息", "扣款", "扣款通知", "通知", "付款", "付款申请", "结算", "结算表", "台账", "物流", "签收", "清单",
    "图", "图里", "节点", "边", "关系", "证据链", "事实", "段落", "字段", "特征", "总览", "概览", "总体", "情况", "状态", "内容", "有什么", "有哪些", "哪些", "什么",
    "列出", "列表", "列一下", "统计", "查看", "查", "看", "一下", "帮我", "请", "请问", "有", "是", "的", "了", "吗", "呢", "啊", "都", "里", "中", "内", "和", "与", "给",
    "我", "你", "它", "现在", "目前",
)
CLAUSE_MARKS, IGNORED_MARKS = "，。、；;", ",.!！?？:：（）()【】[]“”\"'‘’ \t\n\r"

# --- Identity ---
COPY_MARKER = r"([（(]\s*[0-9]{1,3}\s*[)）]|[-_\s]*(副本|拷贝|复件|copyright)([（(]\s*[0-9]{1,3}\s*[)）])?)$"
CORE_SUFFIXES = ("建设项目", "项目工程", "工程")
SIMILAR_MIN, SIMILAR_RATIO = 3, 0.75
HEAD_TAIL_BYTES = 4096
INVOICE_PATTERNS = {
    "invoice_no": (r"发票号码\s*[:：]?\s*([0-9A-Za-z\[\]\-\*]{4,40})", r"号码\s*[:：]?\s*([0-9]{6,30})"),
    "invoice_code": (r"发票代码\s*[:：]?\s*([0-9A-Za-z\[\]\-\*]{4,30})",),
    "invoice_date": (r"开票日期\s*[:：]?\s*([0-9]{4}\s*[年\-/.]\s*[0-9]{1,2}\s*[月\-/.]\s*[0-9]{1,2})", r"开票日期\s*[:：]?\s*(\[DT[0-9]+\])"),
    "seller": (r"销售方[^\n]{0,10}?[:：]?\s*([^\s|，,；;]{1,40})", r"销\s*方[^\n]{0,10}?[:：]?\s*([^\s|，,；;]{1,40})"),
    "buyer": (r"购买方[^\n]{0,10}?[:：]?\s*([^\s|，,；;]{1,40})", r"购\s*方[^\n]{0,10}?[:：]?\s*([^\s|，,；;]{1,40})"),
    "total": (r"价税合计[^\n]{0,20}?[（(]?小写[）)]?\s*[:：]?\s*[¥￥]?\s*([0-9][0-9,\.]{0,20})", r"价税合计\s*[:：]?\s*[¥￥]?\s*([0-9][0-9,\.]{0,20})"),
    "amount": (r"金额\s*[:：]?\s*[¥￥]?\s*([0-9][0-9,\.]{0,20})", r"合\s*计\s*[:：]?\s*[¥￥]?\s*([0-9][0-9,\.]{0,20})"),
    "tax": (r"税额\s*[:：]?\s*[¥￥]?\s*([0-9][0-9,\.]{0,20})",),
    "contract_code": (r"合同编号\s*[:：]?\s*([A-Za-z0-9一-龥\-_/]{2,40})",),
}
PARTY_A = r"甲方(?:（[^）]+）|\([^\)]+\))?[:：]\s*([^\n，,。；;]{2,60})"
UNCHECKED = "待人工核对"
