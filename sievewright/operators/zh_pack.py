"""Vocabularies for Traditional Chinese narratives: facets, and two incident ladders."""

from sievewright.operators.rules import Ladder

# Facet vocabularies, group expansions and stage patterns.
FACETS = {
    "category": {
        "假投資": ["假投資", "投資詐騙", "投資", "股票", "飆股", "帶單", "期貨", "虛擬貨幣", "幣圈"],
        "假交友": ["假交友", "交友詐騙", "交友", "網戀", "感情", "殺豬盤", "約會"],
        "假冒身分": ["假冒身分", "假冒", "冒充", "檢警", "警察", "地檢署", "公務機關", "健保", "國稅局"],
        "購物詐騙": ["購物詐騙", "網購", "購物", "網拍", "賣家", "買家", "分期", "退款"],
        "釣魚訊息": ["釣魚", "詐騙簡訊", "假簡訊", "包裹", "中獎", "補助", "釣魚訊息"],
        "求職詐騙": ["求職詐騙", "求職", "找工作", "打工", "應徵", "車手", "人頭帳戶"],
    },
    "channel": {
        "電話": ["電話", "來電", "打來", "語音"],
        "簡訊": ["簡訊", "sms"],
        "LINE": ["line", "賴"],
        "Facebook": ["facebook", "fb", "臉書", "粉專", "粉絲專頁", "社團"],
        "Instagram": ["instagram", "ig"],
        "交友軟體": ["交友軟體", "交友app", "tinder", "配對"],
        "電子郵件": ["電子郵件", "email", "e-mail", "郵件", "信箱"],
        "網頁廣告": ["網頁廣告", "廣告", "一頁式"],
    },
    "payment": {
        "ATM轉帳": ["atm", "提款機"],
        "網銀匯款": ["網銀", "匯款", "網路銀行", "轉帳"],
        "超商代碼": ["超商", "代碼繳費"],
        "虛擬貨幣": ["虛擬貨幣", "usdt", "比特幣", "加密貨幣", "泰達幣"],
        "遊戲點數": ["遊戲點數", "點數卡", "mycard", "遊戲儲值"],
        "面交": ["面交", "當面", "車手收錢"],
        "信用卡": ["信用卡", "刷卡", "盜刷"],
    },
    "target": {
        "長者": ["長者", "老人", "長輩", "阿公", "阿嬤", "銀髮"],
        "學生": ["學生", "大學生", "高中生", "年輕人"],
        "求職者": ["求職者", "待業"],
        "投資人": ["投資人", "散戶", "投資者"],
        "網購族": ["網購族", "消費者"],
        "上班族": ["上班族", "職員"],
        "單身族": ["單身", "單身族"],
        "家庭主婦": ["家庭主婦", "主婦"],
        "賣家": ["賣家", "二手賣家"],
        "退休族": ["退休族", "退休"],
    },
}
CHANNEL_GROUPS = {
    "網路": ["LINE", "Facebook", "Instagram", "交友軟體", "電子郵件", "網頁廣告"],
    "社群": ["Facebook", "Instagram"],
    "通訊軟體": ["LINE"],
    "手機": ["電話", "簡訊", "LINE"],
}
SHOPPING_STAGES = {
    1: r"看到|刷到|滑到|瀏覽|廣告|貼文|限時動態",
    2: r"私訊|傳訊|留言|詢問|聯繫|加.{0,2}好友",
    3: r"下單|訂購|購買|談好|議價|報價|訂金|下訂",
    4: r"賣貨便|交貨便|店到店|7-?11|全家|萊爾富|物流|寄件|超商",
    5: r"(?i)(^|[^a-z])line([^a-z]|$)|加賴|萊恩|加.{0,2}賴|telegram|facetime",
    6: r"實名制|實名認證|未完成認證|認證失敗|身分驗證|需要驗證",
    7: r"客服|專員|線上客服|銀行人員|行員|業務員",
    8: r"匯款|匯了|轉帳|付款|匯入|支付|轉了|匯過去|繳款|儲值|購買.{0,6}(點數|禮券|禮卷|遊戲卡)|(面交|當面交易|約.{0,4}見面).{0,10}(購買|付|買|交易)|(共計|總計|合計).{0,6}[0-9０-９]|(被騙|被詐騙|詐騙|遭騙|受騙|損失)[^。，]{0,10}(?:[0-9０-９][0-9０-９,，]*|[一二三四五六七八九十百千萬兩數幾上]+)\s*[元萬塊]",
    9: r"(共享|分享)畫面|畫面(共享|分享)|遠端(桌面|控制|連線|軟體)|AnyDesk|TeamViewer|向日葵|無卡提款|付款碼|提款密碼|(ATM|提款機|自動櫃員機)[^。]{0,14}(設定|無卡|解除|英文|轉換|按鍵)|(網銀|網路銀行|網路ATM)[^。]{0,10}(驗證|認證|解除|綁定|設定)|視訊.{0,6}(操作|認證|驗證)|螢幕.{0,4}(共享|分享)|提供.{0,6}(金融卡|提款卡|信用卡).{0,4}密碼",
    10: r"驗證碼|OTP|一次性密碼|簡訊碼|動態密碼",
    11: r"(存款|帳戶|款項|餘額|存簿|戶頭|卡).{0,8}(被|遭)[^。，]{0,8}(轉出|盜領|盜刷|扣|提領|提款|領走|轉走|領出)|(被|遭).{0,3}(盜刷|盜領|盜轉|盜用|盜走)|盜走|(錢|款項|存款|餘額).{0,6}(不見|消失|少了)|不明.{0,4}(交易|扣款|消費|支出|款項)|(變成|淪為|成為).{0,4}人頭帳戶",
}
INVESTMENT_STAGES = {
    21: r"看到|刷到|滑到|廣告|貼文|限時動態|直播",
    22: r"群組|社團|加入|拉我進|邀請",
    23: r"獲利|賺|盈利|報酬|漲|收益|翻倍",
    24: r"老師|分析師|助理|導師|講師|專家|帶單|喊單",
    25: r"下載|安裝|APP|應用程式|註冊.{0,4}(平台|帳號|會員)",
    26: r"虛擬貨幣|加密|USDT|比特幣|以太|泰達",
    27: r"入金|儲值|投入|存入|匯入.{0,6}(平台|帳戶)",
    28: r"(成功|順利).{0,4}出金|出金.{0,4}(成功|順利)|領.{0,2}出來",
    29: r"加碼|追加|再投|加大|更多資金|大筆",
    30: r"稅金|手續費|保證金|解凍|驗資|保金|違約金|解鎖",
    31: r"(無法|不能|沒辦法|不給|不讓).{0,4}(出金|提領|領出)|(出金|提領).{0,4}(失敗|不了|卡住|被拒)|卡住|凍結|鎖定",
}
REPEAT = r"(再|又|二度|第二次|第三次|另外|追加|陸續|多次|數次|好幾次|繼續|不斷|一連串|持續)[^。]{0,10}(匯|轉帳|轉了|付|繳|存入|儲值|加碼)|(匯|轉|付)[^。]{0,6}(第二|第三|兩次|三次|多次|數次)|(一共|總共|前後|合計|累計)[^。]{0,8}(匯|轉|付|筆)|第[一二三四五六七八九十]筆|[0-9０-９]+[ ]*筆[^。]{0,8}(匯|轉|付|款)|更多[^。]{0,6}(匯款|款項|資金|錢|金額)"
SIGNS = (
    ("索取驗證碼", r"驗證碼|OTP|一次性密碼|簡訊碼|動態密碼"),
    ("寄出金融卡或存摺", r"(寄|交|給).{0,8}(提款卡|金融卡|存摺|信用卡|帳戶資料)|(提款卡|金融卡|存摺).{0,6}(寄|交|給)"),
    ("提供證件影本", r"(身分證|健保卡|護照|駕照).{0,6}(照片|影本|正反面|拍照|傳給)"),
)
# End of fixed values.

SHOPPING = Ladder(SHOPPING_STAGES, decisive=(6, 9, 10, 11), suspicious=(4, 5, 7), rungs=(("DRAINED", (11,)), ("CREDENTIALS", (9, 10)), ("REPEATED", ()), ("PAID", (8,))), pay=8, repeat=REPEAT, universal=tuple((n, p, 10 if p == SHOPPING_STAGES[10] else 0) for n, p in SIGNS))
INVESTMENT = Ladder(INVESTMENT_STAGES, decisive=(30, 31), suspicious=(22, 28, 29), rungs=(("DRAINED", (30, 31)), ("REPEATED", (29,)), ("PAID", (27,))), pay=27, repeat=REPEAT, universal=tuple((n, p, 0) for n, p in SIGNS))
