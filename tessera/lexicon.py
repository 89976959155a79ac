"""Word lists that query understanding and ranking go by. The formulas are the same for every lexicon."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """The word lists of one language."""

    filler_characters: str = ""
    stop_terms: tuple[str, ...] = ()
    intent_terms: tuple[str, ...] = ()
    domain_terms: tuple[str, ...] = ()
    generic_terms: tuple[str, ...] = ()
    identifier_hints: tuple[str, ...] = ()
    index_markers: tuple[str, ...] = ()
    replacements: tuple[tuple[str, str], ...] = ()
    final_questions: str = ""
    edge_characters: str = ""
    recall_noise: str = ""
    recall_characters: str = ""
    field_hints: tuple[str, ...] = ()
    summary_terms: tuple[str, ...] = ()
    generic_rows: tuple[str, ...] = ()
    strong_markers: tuple[str, ...] = ()
    temporary_markers: tuple[str, ...] = ()
    knowledge_terms: tuple[str, ...] = ()
    direct_terms: tuple[str, ...] = ()
    fill_columns: tuple[str, ...] = ()
    no_fill_columns: tuple[str, ...] = ()


# The word lists and patterns that results depend on.
CHINESE = Lexicon(
    filler_characters="的吗呢吧么嘛是否有没有请帮想要了解查询检索一下",
    stop_terms=("公司", "企业", "知识库", "文档", "资料", "里面", "相关", "标准吗", "有没有", "是否有"),
    intent_terms=(
        "完整名单", "全体名单", "名单列表", "清单列表", "分别是什么", "有哪些", "有谁", "是谁", "多少个", "多少名",
        "一共有多少", "共有多少", "总人数", "总数", "数量", "名单", "列表", "清单", "明细", "构成", "分别", "全部",
        "所有", "全体", "各个", "各",
    ),
    domain_terms=(
        "办公地点", "直属主管", "负责人", "员工", "部门", "岗位", "职位", "工号", "姓名", "状态", "学历", "邮箱",
        "城市交通", "市内出行", "出租车", "网约车", "火车站", "行程单", "高铁", "飞机", "住宿", "餐补", "报销",
        "审批", "流程", "标准", "费用", "凭证", "发票", "材料", "差旅", "采购", "合同", "付款", "验收", "上线",
        "发布", "灰度", "回滚", "账号", "登录", "密码", "权限", "项目", "文档",
    ),
    generic_terms=(
        "公司", "企业", "城市", "知识库", "文档", "资料", "报销", "审批", "流程", "标准", "费用", "制度", "规范",
        "政策", "手册", "相关",
    ),
    identifier_hints=(
        "员工编号", "员工号", "工号", "人员编号", "用户编号", "产品编号", "产品号", "商品编号", "物料编号", "订单编号",
        "合同编号", "项目编号", "编号", "编码", "型号",
    ),
    index_markers=("查询速查", "优先命中表", "检索提示", "回答参考", "常见问题"),
    replacements=(
        ("根据知识库", ""), ("基于知识库", ""), ("结合知识库", ""), ("企业知识库", ""), ("公司资料", ""),
        ("上传文档", ""), ("查一下", ""), ("查询", ""), ("检索", ""), ("搜索", ""), ("请问", ""), ("帮我", ""),
        ("有没有", ""), ("是否有", ""), ("是否", ""), ("有什么", "什么"), ("有标准", "标准"),
    ),
    final_questions="(是什么|有哪些|如何|怎么|为什么|可以吗|能否|请说明|请解释)$",
    edge_characters="的吗呢吧么嘛请帮想要了解一下",
    recall_noise=(
        "(根据|基于|结合|请问|麻烦|帮我|帮忙|查询|检索|搜索|查一下|查找|公司|企业|每个|各个|所有|全部|分别|哪些|哪几|"
        "是谁|是什么|在哪里|在哪|多少|如何|怎么|为什么|是否|有没有|可以吗|能否|吗|呢|吧|啊)"
    ),
    recall_characters="的之与和及在是有为从到对把将",
    field_hints=(
        "员工", "部门", "岗位", "职位", "工号", "姓名", "婚姻", "状态", "入职", "离职", "手机号", "电话", "邮箱",
        "地址", "身份证", "证件", "账号", "编码", "编号",
    ),
    summary_terms=(
        "统计", "总数", "总人数", "数量", "多少", "共有", "一共", "名单", "列表", "清单", "明细", "构成", "分别",
        "哪些", "有谁",
    ),
    generic_rows=("员工", "人员", "部门", "名单", "列表", "清单", "统计", "总数", "数量"),
    strong_markers=("必须", "明确", "决定", "结论", "长期", "偏好", "目标", "完成"),
    temporary_markers=("今天", "明天", "刚才", "临时", "这次", "当前"),
    knowledge_terms=(
        "知识库", "文档", "资料", "上传", "附件", "引用", "来源", "检索", "搜索", "查一下", "查询", "根据", "基于",
        "结合", "公司", "企业", "内部", "制度", "流程", "规范", "政策", "手册", "项目", "合同", "编号", "编码", "工号",
        "员工编号", "员工号", "产品", "产品编号", "产品号", "型号", "物料", "订单", "申请", "权限", "配置", "环境",
        "接口", "操作", "使用说明", "账号", "密码", "登录", "注册", "常见问题", "修改密码", "重置密码", "找回密码",
        "账号异常", "登录失败", "报销", "审批", "退款", "退货", "退订", "售后", "员工", "客户",
    ),
    direct_terms=("你好", "在吗", "谢谢", "翻译", "润色", "改写", "写一段", "生成", "创作", "代码", "解释一下这段"),
    fill_columns=(
        "部门", "团队", "小组", "班组", "科室", "事业部", "中心", "区域", "地区", "办公地点", "岗位", "职级", "级别",
        "序列", "分类", "类别", "状态", "负责人", "主管", "上级", "项目", "产品",
    ),
    no_fill_columns=(
        "金额", "工资", "薪资", "绩效", "应发", "实发", "数量", "单价", "税", "社保", "公积金", "合计", "总计", "余额",
        "成本", "收入", "支出",
    ),
)

#: A second set for corpora in English.
ENGLISH = Lexicon(
    stop_terms=("company", "document", "documents"),
    identifier_hints=("order number", "product number", "serial number"),
    index_markers=("quick reference", "table of contents", "search hints", "answer notes", "frequently asked"),
    field_hints=("name", "status", "email", "phone", "address", "number"),
    summary_terms=("count", "total", "list", "how many"),
    strong_markers=("must", "decided", "always", "goal", "done"),
    temporary_markers=("today", "tomorrow", "this time", "for now"),
    knowledge_terms=("document", "policy", "manual", "order", "product", "account"),
    direct_terms=("hello", "thanks", "translate", "rewrite", "write a"),
    fill_columns=("department", "team", "group", "region", "category", "status", "segment"),
    no_fill_columns=("amount", "price", "quantity", "tax", "total", "cost"),
)
