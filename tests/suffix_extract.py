"""Suffix rules for tests; jobs read the full list from a file."""

# A short extract of the public suffix list.
SUFFIXES = """
com net org edu gov mil int info biz name pro io co me tv ai app dev xyz online site
ac ad ae ar at au be bg br by ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu id ie il
in ir is it jp kr kz lt lu lv ma mx my nl no nz pe ph pk pl pt ro rs ru sa se sg si sk
th tr tw ua uk us vn za
co.uk org.uk ac.uk gov.uk me.uk net.uk co.il org.il ac.il net.il com.au net.au org.au
co.jp ne.jp or.jp ac.jp com.br com.cn com.mx com.tr com.tw com.sg com.ua co.kr co.nz
co.in co.za co.id com.ar com.my com.ph com.vn
*.ck !www.ck *.bd *.np *.mm
blogspot.com github.io
""".split()
